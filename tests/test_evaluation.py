"""Metrics against brute force on small tables with many ties."""

import datetime as dt
import hashlib
import random

import pytest

from dayglass.operators import stats
from dayglass.session import TUNING, tune

DAY = dt.date(2024, 1, 20)


def table(spark, pairs):
    rows = [(u, DAY, "test", bool(y), float(s)) for u, (s, y) in enumerate(pairs)]
    return spark.createDataFrame(rows, "user_id bigint, day date, split string, is_malicious boolean, risk_score double")


def brute(pairs):
    pos = [s for s, y in pairs if y]
    neg = [s for s, y in pairs if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    ap, seen, hits = 0.0, 0, 0
    for s in sorted({s for s, _ in pairs}, reverse=True):
        group = [y for t, y in pairs if t == s]
        seen, hits = seen + len(group), hits + sum(group)
        ap += sum(group) / len(pos) * hits / seen
    return auc, ap


def ranked(pairs):
    def tie(u):
        return hashlib.sha256(f"{u}|{DAY}".encode()).hexdigest()

    return [y for _, _, y in sorted((-s, tie(u), y) for u, (s, y) in enumerate(pairs))]


@pytest.mark.parametrize("seed", range(4))
def test_metrics(spark, seed):
    rng = random.Random(seed)
    levels = [0.0, 0.0, 0.0, 12.345, 12.3451, 50, 99.9, 100] if seed % 2 else [round(rng.random() * 100, 2) for _ in range(50)]
    pairs = [(rng.choice(levels), rng.random() < 0.1) for _ in range(400)] + [(50.0, True)]
    df = table(spark, pairs)
    row = stats.curve_metrics(stats.score_curve(df)).first()
    auc, ap = brute(pairs)
    assert (row.roc_auc, row.pr_auc) == pytest.approx((auc, ap))
    order = ranked(pairs)
    for r in stats.topk_hits(df):
        assert r["hits"] == sum(order[:r["k"]])


def test_one_tie_group_holds_everything(spark):
    pairs = [(0.0, u % 7 == 0) for u in range(300)]
    order = ranked(pairs)
    for r in stats.topk_hits(table(spark, pairs), (0.01, 0.5, 1.0)):
        assert r["hits"] == sum(order[:r["k"]])


def test_unscored_sessions_count_as_misses(spark):
    pairs = [(100.0 - u, u < 5) for u in range(100)]
    scored = table(spark, pairs)
    for none in ("NULL", "'NaN'"):
        lost = scored.limit(5).selectExpr("user_id + 1000 AS user_id", "day", "split", "true AS is_malicious", f"CAST({none} AS DOUBLE) AS risk_score")
        row = stats.evaluation_report(scored.unionByName(lost)).first()
        assert (row.n_sessions, row.n_malicious_labeled) == (105, 10)
        assert row.recall_top5pct == 0.5 and row.precision_top5pct == 1.0
        assert row.roc_auc == 0.5


def test_half_even_rounding(spark):
    # one positive among 16 rows at the cut: 1/16 = 0.0625
    pairs = [(100.0, u == 0) for u in range(16)] + [(0.0, False)] * 304
    assert stats.evaluation_report(table(spark, pairs)).first().precision_top5pct == 0.062


def test_no_positives(spark):
    row = stats.evaluation_report(table(spark, [(1.0, False), (2.0, False), (3.0, False)])).first()
    assert row.roc_auc is None and row.pr_auc is None
    assert (row.n_sessions, row.n_malicious_labeled, row.imbalance_ratio) == (3, 0, "1:3")
    assert row.recall_top1pct == 0.0


def test_empty_tiers_are_kept(spark, cfg):
    from pyspark.sql import functions as F

    from dayglass.functions.expressions import risk_tier

    df = table(spark, [(1.0, False), (50.0, True)]).withColumn("risk_tier", risk_tier(F.col("risk_score"), cfg))
    got = {r.risk_tier: r.n for r in stats.tier_counts(df, cfg).collect()}
    assert got == {"Low": 1, "Medium": 1, "High": 0, "Critical": 0}


def test_train_rate_counts_all_sessions_and_the_held_out_rate_benign_ones(spark):
    rows = [("train", True, "High"), ("train", False, "Low"), ("test", True, "High"), ("test", False, "Medium"), ("test", False, "Low")]
    got = {r.split: (r.n, r.fpr_high, r.fpr_medium) for r in stats.false_positive_rates(
        spark.createDataFrame(rows, "split string, is_malicious boolean, risk_tier string")).collect()}
    assert got == {"train": (2, 0.5, 0.5), "test": (2, 0.0, 0.5)}


def test_tune_leaves_settings_of_the_session_alone(spark):
    key, before = "spark.sql.codegen.hugeMethodLimit", spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    try:
        spark.conf.set(key, "12345")
        assert tune(spark).conf.get(key) == "12345"
        spark.conf.unset(key)
        assert tune(spark).conf.get(key) == TUNING[key]
    finally:
        spark.conf.set(key, before)
