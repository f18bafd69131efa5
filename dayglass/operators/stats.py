"""Exact order statistics, fitted moments and evaluation metrics, all as Spark aggregates.

Per-group results that are joined back to the rows they came from are written first. A written
table has a size that Spark knows when it plans, so it broadcasts the small ones and never
shuffles the rows by a group that may hold most of them; a large one is joined as usual.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import EngineConfig
from ..session import materialize

# Accuracy of the quantile sketch that brackets a median, and the bracket's half width in
# units of the sketch's rank error.
SKETCH = 100_000
MARGIN = 4 / SKETCH


# ---- medians and robust baselines --------------------------------------------------------
def _bracket(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    ends = F.percentile_approx("_x", [0.5 - MARGIN, 0.5 + MARGIN], SKETCH)
    return rows.groupBy(*keys).agg(F.count("_x").alias("n"), ends.alias("_ends"))


def exact_median(df: DataFrame, value: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Median per group (NULLs ignored): keys, n, median.

    `percentile` would hold every distinct value of a group in one task. Here a bounded sketch
    brackets the middle rank first; then one combining aggregate counts what lies below the
    bracket and the distinct values inside it, and only those (about 1 value in 10,000) are
    ordered. The sketch's error bound guarantees that the bracket holds the middle; should it
    ever not, the query fails instead of returning a wrong number.
    """
    keys = list(keys)
    rows = df.select(*keys, value.cast("double").alias("_x")).where(F.col("_x").isNotNull())
    ends = _bracket(rows, keys)
    if keys:
        rows = rows.join(materialize(ends, "brackets"), keys)
    else:  # one group: its bracket is one row, so it travels as literals
        found = ends.first()
        low, high = found["_ends"] or (None, None)
        rows = rows.withColumns({"n": F.lit(found["n"]).cast("bigint"),
                                 "_ends": F.array(F.lit(low).cast("double"), F.lit(high).cast("double"))})
    inside = F.when(F.col("_x") >= F.col("_ends")[0], F.col("_x"))
    steps = (rows.where(F.col("_x") <= F.col("_ends")[1])
             .groupBy(*keys, "n", inside.alias("_x")).agg(F.count("*").alias("_c")))
    upto = Window.partitionBy(*keys, "n").orderBy(F.col("_x").asc_nulls_first())
    steps = steps.withColumn("_cum", F.sum("_c").over(upto.rowsBetween(Window.unboundedPreceding, 0)))
    lower, upper = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_cum") >= rank) & (F.col("_cum") - F.col("_c") < rank), F.col("_x")))

    missed = F.raise_error(F.lit("median outside its bracket")).cast("double")
    return steps.groupBy(*keys, "n").agg(F.coalesce((at(lower) + at(upper)) / 2, missed).alias("median"))


def robust_baseline(df: DataFrame, value: Column, keys: Sequence[str] = ()) -> DataFrame:
    """keys, n, baseline (median) and scale: 1.4826 x MAD, else the population standard
    deviation, else 1."""
    keys = list(keys)
    rows = df.select(*keys, value.cast("double").alias("_v"))
    middle = exact_median(rows, F.col("_v"), keys).withColumnRenamed("median", "baseline")
    spread = rows.groupBy(*keys).agg(F.stddev_pop("_v").alias("std"))
    if keys:
        middle = materialize(middle, "medians")
        away = rows.join(middle, keys)
        mad = exact_median(away, F.abs(F.col("_v") - F.col("baseline")), keys)
        fit = (middle.join(mad.select(*keys, F.col("median").alias("mad")), keys)
               .join(spread, keys))
    else:
        m, s = middle.first(), spread.first()
        centre = F.lit(m["baseline"] if m else None).cast("double")
        mad = exact_median(rows, F.abs(F.col("_v") - centre))
        fit = mad.select("n", centre.alias("baseline"), F.col("median").alias("mad"),
                         F.lit(s["std"]).cast("double").alias("std"))
    scale = (F.when(F.col("mad") > 0, F.col("mad") * 1.4826)
             .when(F.col("std") != 0, F.col("std")).otherwise(F.lit(1.0)))
    return fit.select(*keys, "n", "baseline", "mad", "std", scale.alias("scale"))


# ---- moments -----------------------------------------------------------------------------
def scaler_fit(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: mean and population standard deviation per column, zero deviation as 1."""
    mean = [F.avg(c).alias(f"mean_{c}") for c in columns]
    std = [F.when(F.stddev_pop(c) == 0, F.lit(1.0)).otherwise(F.stddev_pop(c)).alias(f"std_{c}") for c in columns]
    return df.agg(F.count("*").alias("n"), *mean, *std)


def standardised(columns: Sequence[str], params) -> list[Column]:
    """The columns scaled by the one-row result of `scaler_fit`."""
    return [((F.col(c) - F.lit(params[f"mean_{c}"])) / F.lit(params[f"std_{c}"])).alias(c) for c in columns]


def group_moments(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), shift: Sequence[float] | None = None) -> DataFrame:
    """n, mean[], std[] (population) and cov[] (sample, row-major square) per group.

    One pass: sums and sums of products of the values less `shift`, by default their means over
    all groups. That takes out what the groups have in common, so the sums hardly cancel; they
    merge map-side, so a dominant group is no hot spot, and no row meets its group's mean.
    """
    keys, d = list(keys), len(columns)
    if shift is None:
        shift = df.agg(*[F.avg(c) for c in columns]).first()
    shift = [float(x or 0.0) for x in shift]
    rows = df.select(*keys, *[(F.col(c) - F.lit(x)).alias(f"_{i}") for i, (c, x) in enumerate(zip(columns, shift))])
    sums = [F.sum(f"_{i}").alias(f"_t{i}") for i in range(d)]
    products = [F.sum(F.col(f"_{i}") * F.col(f"_{j}")).alias(f"_s{i}_{j}") for i in range(d) for j in range(i, d)]
    found = rows.groupBy(*keys).agg(F.count("*").alias("n"), *sums, *products)
    found = found.withColumns({"_n": F.col("n").cast("double"), "_free": F.when(F.col("n") > 1, F.col("n") - 1).cast("double")})

    def scatter(i: int, j: int) -> Column:
        i, j = min(i, j), max(i, j)
        return F.col(f"_s{i}_{j}") - F.col(f"_t{i}") * F.col(f"_t{j}") / F.col("_n")

    mean = [F.col(f"_t{i}") / F.col("_n") + F.lit(x) for i, x in enumerate(shift)]
    std = [F.sqrt(F.greatest(scatter(i, i), F.lit(0.0)) / F.col("_n")) for i in range(d)]
    cov = [scatter(i, j) / F.col("_free") for i in range(d) for j in range(d)]
    return found.select(*keys, "n", F.array(*mean).alias("mean"), F.array(*std).alias("std"), F.array(*cov).alias("cov"))


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def tier_counts(scored: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Sessions per tier and split; tiers without sessions are kept with zero."""
    cells = [F.count_if(F.col("risk_tier") == label).alias(label) for *_, label in cfg.tiers]
    wide = scored.groupBy("split").agg(*cells)
    names = [label for *_, label in cfg.tiers]
    return wide.unpivot("split", names, "risk_tier", "n")


def false_positive_rates(scored: DataFrame) -> DataFrame:
    """Share of sessions called High or above, and Medium or above, per split: of all training
    sessions, and of the benign held-out ones."""
    high = F.avg(F.when(F.col("risk_tier").isin("High", "Critical"), 1.0).otherwise(0.0))
    medium = F.avg(F.when(F.col("risk_tier").isin("Medium", "High", "Critical"), 1.0).otherwise(0.0))
    return (scored.where((F.col("split") == "train") | ~F.col("is_malicious")).groupBy("split")
            .agg(F.count("*").alias("n"), high.alias("fpr_high"), medium.alias("fpr_medium")))


# ---- ranked prefixes ---------------------------------------------------------------------
BUCKETS_PER_POINT = 100


def _rank_score(score: str) -> Column:
    """The score to rank by: least of all where there is none."""
    least = F.lit(float("-inf"))
    return F.coalesce(F.nanvl(F.col(score).cast("double"), least), least)


def score_curve(df: DataFrame, score: str = "risk_score", label: str = "is_malicious") -> DataFrame:
    """One row per distinct score, with rows and positives at and above it.

    A global running sum without a global sort: distinct scores are counted with map-side
    combine (so ties, however many, are one row), fall into at most 10,001 score buckets, and
    only the bucket totals pass through one ordered window; each bucket then runs its own.
    Sessions without a score rank below all others, so a labelled one counts as a miss.
    """
    positive = F.sum(F.col(label).cast("bigint")).alias("pos")
    steps = df.groupBy(_rank_score(score).alias("score")).agg(F.count("*").alias("n"), positive)
    clipped = F.greatest(F.least(F.col("score"), F.lit(100.0)), F.lit(0.0))
    steps = steps.withColumn("bucket", F.floor(clipped * BUCKETS_PER_POINT).cast("int"))
    above = Window.orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    totals = steps.groupBy("bucket").agg(F.sum("n").alias("_n"), F.sum("pos").alias("_p"))
    totals = totals.select("bucket", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_n0"),
                           F.coalesce(F.sum("_p").over(above), F.lit(0)).alias("_p0"))
    inside = (Window.partitionBy("bucket").orderBy(F.col("score").desc())
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    steps = steps.withColumns({"cum_n": F.sum("n").over(inside), "cum_pos": F.sum("pos").over(inside)})
    return steps.join(totals, "bucket").select(
        "score", "n", "pos", (F.col("cum_n") + F.col("_n0")).alias("cum_n"),
        (F.col("cum_pos") + F.col("_p0")).alias("cum_pos"))


def curve_metrics(curve: DataFrame) -> DataFrame:
    """One row: n, positives, ROC-AUC (ties count half) and step-wise average precision.

    Without positives both metrics are NULL; without negatives the ROC-AUC is.
    """
    n, pos = F.col("n").cast("double"), F.col("pos").cast("double")
    negatives = n - pos
    negatives_above = F.col("cum_n") - F.col("cum_pos") - negatives
    # pairs (positive, negative) in which the negative ranks above, ties counted half
    lost = F.sum(pos * (negatives_above + negatives / 2))
    gain = F.sum(pos * F.col("cum_pos") / F.col("cum_n"))
    total, hits = F.sum(n), F.sum(pos)
    return curve.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_sessions"),
        F.coalesce(F.sum("pos"), F.lit(0)).alias("n_malicious_labeled"),
        F.when(hits > 0, 1 - lost / F.nullif(hits * (total - hits), F.lit(0.0))).alias("roc_auc"),
        F.when(hits > 0, gain / F.nullif(hits, F.lit(0.0))).alias("pr_auc"))


# ---- top-k recall --------------------------------------------------------------------------
TOP_SHARES = (0.01, 0.02, 0.05)
TIE_BUCKETS = 4096


def _tie_hash(key: Sequence[str]) -> Column:
    """Order among equal scores: a fixed hash of the session key, spread evenly."""
    return F.sha2(F.concat_ws("|", *[F.col(k).cast("string") for k in key]), 256)


def _cut_rows(n: int, share: float) -> int:
    return max(1, int(round(n * share)))


def topk_hits(df: DataFrame, shares: Sequence[float] = TOP_SHARES, score: str = "risk_score",
              label: str = "is_malicious", key: Sequence[str] = ("user_id", "day")) -> list[dict]:
    """Positives among the k best-scored sessions for each share of all sessions.

    Nothing is sorted as a whole. Sessions strictly above the cut score are summed from the
    curve; of the one tie group at the cut, 4,096 hash buckets are counted, and only the
    bucket that the cut falls into is ordered row by row.
    """
    curve = score_curve(df, score, label)
    size = curve.agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).first()
    n, pos = size["n"] or 0, size["pos"] or 0
    cuts = {s: _cut_rows(n, s) for s in shares}
    before = F.col("cum_n") - F.col("n")
    found = curve.where(" OR ".join(f"(cum_n - n < {k} AND cum_n >= {k})" for k in cuts.values()))
    steps = found.select("score", "n", "pos", before.alias("n0"), (F.col("cum_pos") - F.col("pos")).alias("p0")).collect()
    out = []
    for part, k in cuts.items():
        at = next((r for r in steps if r["n0"] < k <= r["n0"] + r["n"]), None)
        if at is None:  # no rows at all
            hits = 0
        elif k == at["n0"] + at["n"] or at["pos"] in (0, at["n"]):
            hits = at["p0"] + (min(k - at["n0"], at["pos"]) if at["pos"] in (0, at["n"]) else at["pos"])
        else:
            hits = at["p0"] + _tie_hits(df.where(_rank_score(score) == F.lit(at["score"])), k - at["n0"], label, key)
        out.append({"share": part, "k": k, "n": n, "n_positive": pos, "hits": int(hits)})
    return out


def _tie_hits(ties: DataFrame, take: int, label: str, key: Sequence[str]) -> int:
    rows = ties.select(_tie_hash(key).alias("h"), F.col(label).cast("bigint").alias("y"))
    rows = rows.withColumn("b", F.conv(F.substring("h", 1, 3), 16, 10).cast("int"))
    done = hits = 0
    # at most TIE_BUCKETS rows of totals
    for b in rows.groupBy("b").agg(F.count("*").alias("n"), F.sum("y").alias("pos")).orderBy("b").collect():
        if done + b["n"] < take:
            done, hits = done + b["n"], hits + b["pos"]
            continue
        rest = rows.where(F.col("b") == b["b"])
        ranked = rest.withColumn("r", F.row_number().over(Window.partitionBy("b").orderBy("h")))
        return hits + (ranked.where(F.col("r") <= take - done).agg(F.sum("y")).first()[0] or 0)
    return hits


def topk_report(df: DataFrame, **options) -> DataFrame:
    rows = topk_hits(df, **options)
    return df.sparkSession.createDataFrame(
        [(r["share"], r["k"], r["hits"], r["hits"] / max(r["n_positive"], 1), r["hits"] / r["k"]) for r in rows],
        "share double, k bigint, hits bigint, recall_at_k double, precision_at_k double")


def evaluation_report(df: DataFrame, score: str = "risk_score", label: str = "is_malicious",
                      key: Sequence[str] = ("user_id", "day")) -> DataFrame:
    """The detection report of one labelled, scored table in one row."""
    metrics = curve_metrics(score_curve(df, score, label))
    cells = {}
    for r in topk_hits(df, TOP_SHARES, score, label, key):
        name = f"top{int(r['share'] * 100)}pct"
        cells[f"recall_{name}"] = F.bround(F.lit(r["hits"] / max(r["n_positive"], 1)), 3)
        cells[f"precision_{name}"] = F.bround(F.lit(r["hits"] / r["k"]), 3)
    rate = F.bround((F.col("n_sessions") - F.col("n_malicious_labeled"))
                    / F.greatest(F.col("n_malicious_labeled"), F.lit(1)))
    return metrics.select(
        "n_sessions", "n_malicious_labeled",
        F.concat(F.lit("1:"), rate.cast("bigint").cast("string")).alias("imbalance_ratio"),
        F.bround("roc_auc", 4).alias("roc_auc"), F.bround("pr_auc", 4).alias("pr_auc"),
        *[v.alias(k) for k, v in cells.items()])
