"""Verdicts of the quality rules, where cutoffs are certified, against their SQL twin."""

import duckdb
from pyspark.sql import functions as F

from dayglass.llm import quality_rules

SF = "/root/testdata/sf0.1"


def test_verdicts_equal_the_sql_twin(spark):
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    want = {r[0]: r[1:] for r in con.execute(f"SELECT doc_id, base_failed, kept, rejected_by FROM ({quality_rules.ORACLE})").fetchall()}
    got = {r.doc_id: (r.base_failed, r.kept, r.rejected_by) for r in quality_rules.query(spark, SF).collect()}
    assert got == want
    assert {v[2] for v in got.values()} > {None, "base"}  # a cutoff has been certified, and rejects


def test_copies_are_one_trial(spark):
    good = [(k, "en", f"word{k} " * 3 + "some plain words to make the text long enough") for k in range(2000)]
    bad = " ".join(f"#{c}#" for c in "abcdefghij") + " a copy full of signs"
    docs = spark.createDataFrame([*good, *((5000 + k, "en", bad) for k in range(300))], "doc_id long, lang string, text string")
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    judged = quality_rules.judge(docs, labels)
    assert quality_rules.COPY not in judged.columns
    counted = quality_rules.with_counts(docs.withColumn(quality_rules.COPY, F.md5("text")))
    once = quality_rules.fit_cutoffs(counted, labels).first()
    each = quality_rules.fit_cutoffs(counted.drop(quality_rules.COPY), labels).first()
    # one text with 20 symbols in 46 characters among 2001, or 300 among 2300
    assert (once.cut_symbols, each.cut_symbols) == (0.01, 0.5)
