"""Plan shapes that must hold, and the driver contract."""

import glob
import os
import re
import subprocess
import sys

import duckdb
import pytest

from conftest import SF_DIR

from dayglass.operators import features, lookup, sessions
from dayglass.plans.oracle_text import ORACLES
from dayglass.plans.registry import QUERIES, Inputs, shown


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


CHEAP = [n for n in QUERIES if n not in ("q_scored", "q_detection_report", "q_policy_run", "q_forest_score", "q_peer_score")]


@pytest.mark.parametrize("name", CHEAP)
def test_no_cross_products(spark, name):
    text = plan(QUERIES[name](Inputs(spark, SF_DIR)))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_fold_reads_the_events_once_and_prunes(inputs):
    text = plan(sessions.activity_cells(inputs.activity))
    assert text.count("FileScan parquet") == 1 and len(re.findall(r"Exchange hashpartitioning", text)) == 1
    assert "partial_" in text  # combined before the shuffle
    scan = plan(features.session_bigrams(inputs.activity, inputs.cfg, largest=1))
    assert "value" not in re.search(r"ReadSchema: struct<([^>]*)>", scan).group(1)
    assert "event_type" in re.search(r"PushedFilters: \[([^\]]*)\]", scan).group(1)


def test_no_single_partition_over_rows(inputs):
    for df in (inputs.user_days, inputs.decision_events, inputs.chained, inputs.states):
        assert "SinglePartition" not in plan(df)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


# the whole list is compared at sf0.01 by tools/check_oracles.py
@pytest.mark.parametrize("name", ["q_user_day", "q_feature_matrix", "q_hash_chain", "q_lease_outcomes", "q_eval_report", "q_contributions"])
def test_against_duckdb(spark, duck, name):
    df = QUERIES[name](Inputs(spark, SF_DIR))
    columns = sorted(df.columns)
    answer = duck.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(map(tuple, df.select(*columns).collect()), key=key) == sorted(answer, key=key)


def test_results_are_plain(spark, inputs):
    kinds = {k for _, k in shown(inputs.scored).dtypes}
    assert kinds <= {"bigint", "double", "string"}


def test_entry_runs_from_any_folder():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (f"import importlib.util as u; s = u.spec_from_file_location('e', {root!r} + '/__spark_entry__.py');"
            "m = u.module_from_spec(s); s.loader.exec_module(m);"
            "from pyspark.sql import SparkSession;"
            "spark = SparkSession.builder.master('local[4]').config('spark.ui.enabled', 'false')"
            ".config('spark.sql.session.timeZone', 'Asia/Tokyo').config('spark.sql.shuffle.partitions', '4').getOrCreate();"
            "print('rows', m.entry(spark).count())")
    done = subprocess.run([sys.executable, "-c", code], cwd="/tmp", capture_output=True, text=True, timeout=300)
    assert "rows 397" in done.stdout, done.stderr[-2000:]


# ---- lookups by role
BY_ROLE = ["q_compressed_z", "q_excess_by_role", "q_drilldown", "q_contributions", "q_mahalanobis_2d", "q_peer_score", "q_lease_grants",
           "q_decision_events", "q_resume_events"]


@pytest.mark.parametrize("name", BY_ROLE)
def test_facts_are_not_dealt_by_role(spark, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20480")
    try:
        text = plan(QUERIES[name](Inputs(spark, SF_DIR)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not re.search(r"hashpartitioning\(role#\d+, \d+\)", text)


def test_a_table_too_large_to_broadcast_is_salted(spark, monkeypatch):
    facts = spark.range(2000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 7 = 0 THEN NULL ELSE string(id % 50) END AS role")
    table = spark.range(40).selectExpr("string(id) AS role", "id AS n").unionByName(spark.sql("SELECT 'hot' AS role, 99L AS n"))
    want = sorted(map(tuple, facts.join(table, "role", "left").select("id", "role", "n").collect()))
    for limit in (lookup.LOOKUP_BYTES, 0):
        monkeypatch.setattr(lookup, "LOOKUP_BYTES", limit)
        got = lookup.attach(facts, table, ["role"])
        assert sorted(map(tuple, got.select("id", "role", "n").collect())) == want and got.columns == ["role", "id", "n"]
        assert ("_salt" in got._jdf.queryExecution().analyzed().toString()) == (limit == 0)
    assert lookup.attach(facts, table, ["role"], "inner").count() == sum(r[2] is not None for r in want)
