"""The ten behavioural features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import EngineConfig
from ..functions.expressions import entropy_bits, entropy_terms, split_of
from ..session import materialize
from . import timeline
from .sessions import (
    HOURS, SESSION, after_hours, attach_labels, attach_roles, fold_activity, token_rows,
)


def entropy_of(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Entropy in bits of `column` within each group, from counts per distinct value: the
    bag itself is never gathered."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("c"))
    parts = counts.groupBy(*keys).agg(F.sum("c").cast("double").alias("n"),
                                      F.sum(F.col("c") * F.log2("c")).alias("s"))
    return parts.select(*keys, entropy_bits(F.col("n"), F.col("s")).alias("entropy"))


def _in_last_days(counter: Column, days: int) -> Column:
    """Sum of a counter over the last `days` calendar days, the row's own included.

    Taken as a difference of two running sums. Spark extends such frames row by row, whereas
    it re-adds every row of a bounded frame for each output row.
    """
    by_day = Window.partitionBy("user_id").orderBy(F.unix_date("day"))
    upto = F.sum(counter).over(by_day.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    older = F.sum(counter).over(by_day.rangeBetween(Window.unboundedPreceding, -days))
    return upto - F.coalesce(older, F.lit(0))


BITS = 8  # room per weekday in the packed counter: windows of up to 255 weeks


def rolling_entropies(user_days: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Entropy of event hours and of active weekdays over their calendar windows.

    Both windows slide over counters of folded user-days, so a user costs at most one row per
    day, and share one sort. Each active day counts once for the weekday, whatever its events;
    the seven weekday counts therefore fit into one packed number.
    """
    one_day = F.expr(f"shiftleft(1L, {BITS} * weekday(day))")
    sums = {f"_{c}": _in_last_days(F.col(c), cfg.hour_window_days) for c in HOURS}
    sums["_dow"] = _in_last_days(one_day, cfg.dow_window_days)
    mask = (1 << BITS) - 1
    dows = {f"_d{d}": F.shiftright("_dow", BITS * d).bitwiseAND(F.lit(mask)) for d in range(7)}
    rows = user_days.withColumns(sums).withColumns(dows)
    rows = with_entropy(rows, [f"_{c}" for c in HOURS], "hour_entropy_7d")
    rows = with_entropy(rows, list(dows), "dow_entropy_30d")
    return rows.drop(*sums, *dows)


def with_entropy(df: DataFrame, counters: list[str], out: str) -> DataFrame:
    """Shannon entropy in bits of a bag given as one counter column per distinct value: an
    empty bag has none. One term per counter, in short projections that compile well."""
    n, spread = entropy_terms([F.col(c) for c in counters])
    return (df.withColumns({"_n": n, "_spread": spread})
            .withColumn(out, entropy_bits(F.col("_n"), F.col("_spread"))).drop("_n", "_spread"))


def first_seen(cells: DataFrame) -> DataFrame:
    """First day of every (user, host) and (user, device), from cells or from the activity itself."""
    pairs = cells.groupBy("user_id", "pc", "device_id").agg(F.min("day").alias("day"))
    items = pairs.select("user_id", "day", F.explode(F.array(
        F.struct(F.lit("host").alias("kind"), F.col("pc").alias("item")),
        F.struct(F.lit("device").alias("kind"), F.col("device_id").alias("item")))).alias("i"))
    return (items.where("i.item IS NOT NULL").groupBy("user_id", "i.kind", "i.item")
            .agg(F.min("day").alias("day")))


def new_item_days(cells: DataFrame, user_days: DataFrame, cfg: EngineConfig) -> DataFrame:
    """User-days on which a host or device shows up for the first time after the warm-up."""
    start = user_days.groupBy("user_id").agg(F.min("day").alias("start"))
    late = (first_seen(cells).join(start, "user_id")
            .where(F.datediff("day", "start") >= cfg.warmup_days))
    return late.groupBy(*SESSION).agg(
        F.max(F.when(F.col("kind") == "host", 1).otherwise(0)).alias("new_host_flag"),
        F.max(F.when(F.col("kind") == "device", 1).otherwise(0)).alias("new_device_flag"))


# ---- sequence rarity -----------------------------------------------------------------------
def session_bigrams(activity: DataFrame, cfg: EngineConfig, largest: int | None = None) -> DataFrame:
    """Adjacent token pairs of each session with their number: (user, day, kind, a, b, n)."""
    rows = timeline.next_in_order(token_rows(activity), [*SESSION, "kind"], "ts", "event_id",
                                  F.col("token"), "b", cfg, largest)
    return (rows.where("b IS NOT NULL").groupBy(*SESSION, "kind", F.col("token").alias("a"), "b")
            .agg(F.count("*").alias("n")))


def bigram_counts(bigrams: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Population counts; `rarity_scope='train'` freezes them on the training days."""
    if cfg.rarity_scope == "train":
        bigrams = bigrams.where(split_of("day", cfg) == "train")
    return bigrams.groupBy("kind", "a", "b").agg(F.sum("n").alias("count"))


def bigram_rarity(bigrams: DataFrame, counts: DataFrame) -> DataFrame:
    """Mean -log2 probability of each session's pairs, one column per sequence kind.

    The lookup is a plain equi-join: Spark broadcasts the counts only if their measured size
    is under its threshold, else it shuffles and splits hot pairs at run time. Pairs missing
    from frozen counts are taken as seen once in one more observation.
    """
    totals = counts.groupBy("kind").agg(F.sum("count").alias("total"))
    priced = (bigrams.join(counts, ["kind", "a", "b"], "left").join(totals, "kind", "left"))
    bits = F.coalesce(-F.log2(F.col("count") / F.col("total")),
                      F.log2(F.coalesce("total", F.lit(0)) + 1.0))
    priced = priced.withColumn("bits", bits * F.col("n"))

    def mean(kind: str) -> Column:
        mine = F.col("kind") == kind
        return (F.sum(F.when(mine, F.col("bits"))) / F.sum(F.when(mine, F.col("n")))).alias(f"{kind}_bigram_rarity")

    return priced.groupBy(*SESSION).agg(mean("url"), mean("file"))


# ---- assembly --------------------------------------------------------------------------------
def volumes(user_days: DataFrame) -> DataFrame:
    """Web uploads count in both volumes; removable bytes are part of the file volume."""
    return (user_days
            .withColumn("data_volume_mb",
                        F.col("file_volume_mb") + F.col("email_volume_mb") + F.col("http_export_mb"))
            .withColumn("export_volume_mb", F.col("export_volume_mb") + F.col("http_export_mb")))


def feature_matrix(activity: DataFrame, directory: DataFrame, answers: DataFrame, cfg: EngineConfig,
                   counts: DataFrame | None = None) -> DataFrame:
    """Id columns and the ten features of every user-day."""
    return priced_features(activity, directory, answers, cfg, counts)[0]


def priced_features(activity: DataFrame, directory: DataFrame, answers: DataFrame, cfg: EngineConfig,
                    counts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The feature matrix, and the pair counts that priced its sequences.

    User-days and bigrams are written once to the shared folder, as several branches
    read them.
    Pass frozen `counts` to price sequences against an earlier period.
    """
    days = materialize(fold_activity(activity), "user-days")
    largest = days.agg(F.max(F.greatest("n_http_events", "n_file_events"))).first()[0] or 0
    bigrams = materialize(session_bigrams(activity, cfg, largest), "bigrams")
    if counts is None:
        counts = materialize(bigram_counts(bigrams, cfg), "bigram-counts")
    rarity = bigram_rarity(bigrams, counts)
    flags = new_item_days(activity, days, cfg)

    # roles first, while rows are still partitioned by user; the other joins share (user, day)
    table = attach_roles(rolling_entropies(days, cfg), directory)
    table = volumes(table.withColumn("after_hours_ratio", after_hours(cfg)))
    table = attach_labels(table.join(flags, SESSION, "left").join(rarity, SESSION, "left"), answers)
    numbers = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cfg.features]
    return table.select("user_id", "role", "day", "is_malicious", "scenario_id",
                        split_of("day", cfg).alias("split"), *numbers), counts
