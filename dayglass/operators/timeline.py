"""Ordered operators over (keys, ts, id) that stay parallel when one key is hot.

`next_in_order`, `last_seen`, `next_seen` and `position` are the window functions lead,
last-value, first-value and row_number. A plain window runs each group in one task, which is
right for ordinary groups and wrong when a single key holds a large part of all rows. So the
group sizes are looked at first (one aggregate with map-side combine, one number back). Only
if a group exceeds `cfg.hot_group_rows` is the time axis cut into slices: each (keys, slice)
is its own window group, one summary row per slice is carried over the slice borders, and the
summary is joined back on the partitioning the rows already have. Both forms give the same
rows; no row is dropped or sampled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import EngineConfig
from ..functions.expressions import epoch_micros

SLICE = "_slice"


def largest_group(df: DataFrame, keys: list[str]) -> int:
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def is_hot(df: DataFrame, keys: list[str], cfg: EngineConfig, largest: int | None = None) -> bool:
    """`largest` saves the look when the caller already knows the greatest group size."""
    return (largest_group(df, keys) if largest is None else largest) > cfg.hot_group_rows


def _sliced(df: DataFrame, ts: str, cfg: EngineConfig) -> DataFrame:
    return df.withColumn(SLICE, F.floor(epoch_micros(ts) / F.lit(cfg.slice_seconds * 1_000_000)))


def _attach(rows: DataFrame, per_slice: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(per_slice, [*keys, SLICE], "left")


def next_in_order(df: DataFrame, keys: list[str], ts: str, tie: str, value: Column, out: str,
                  cfg: EngineConfig, largest: int | None = None) -> DataFrame:
    """`out` is the value of the following row of the group, NULL on its last row.
    Values must not be NULL."""
    if not is_hot(df, keys, cfg, largest):
        return df.withColumn(out, F.lead(value).over(Window.partitionBy(*keys).orderBy(ts, tie)))
    rows = _sliced(df, ts, cfg)
    heads = rows.groupBy(*keys, SLICE).agg(F.min_by(value, F.struct(ts, tie)).alias("_head"))
    heads = heads.withColumn("_carry", F.lead("_head").over(Window.partitionBy(*keys).orderBy(SLICE)))
    inside = Window.partitionBy(*keys, SLICE).orderBy(ts, tie)
    rows = rows.withColumn(out, F.lead(value).over(inside))
    rows = _attach(rows, heads.drop("_head"), keys)
    return rows.withColumn(out, F.coalesce(out, "_carry")).drop("_carry", SLICE)


def _seen(df, keys, ts, tie, value, out, cfg, largest, forward: bool) -> DataFrame:
    def order(*names):
        return [F.col(n).asc() if forward else F.col(n).desc() for n in names]

    whole = (Window.unboundedPreceding, Window.currentRow)
    if not is_hot(df, keys, cfg, largest):
        w = Window.partitionBy(*keys).orderBy(*order(ts, tie)).rowsBetween(*whole)
        return df.withColumn(out, F.last(value, ignorenulls=True).over(w))
    rows = _sliced(df, ts, cfg).withColumn("_value", value)
    edge = F.max_by if forward else F.min_by
    marked = F.when(F.col("_value").isNotNull(), F.struct(ts, tie))
    tails = rows.groupBy(*keys, SLICE).agg(edge("_value", marked).alias("_edge"))
    before = (Window.partitionBy(*keys).orderBy(*order(SLICE))
              .rowsBetween(Window.unboundedPreceding, -1))
    tails = tails.withColumn("_carry", F.last("_edge", ignorenulls=True).over(before))
    inside = Window.partitionBy(*keys, SLICE).orderBy(*order(ts, tie)).rowsBetween(*whole)
    rows = rows.withColumn(out, F.last("_value", ignorenulls=True).over(inside))
    rows = _attach(rows, tails.drop("_edge"), keys)
    return rows.withColumn(out, F.coalesce(out, "_carry")).drop("_carry", "_value", SLICE)


def last_seen(df: DataFrame, keys: list[str], ts: str, tie: str, value: Column, out: str,
              cfg: EngineConfig, largest: int | None = None) -> DataFrame:
    """`out` is the latest non-NULL value at or before the row."""
    return _seen(df, keys, ts, tie, value, out, cfg, largest, forward=True)


def next_seen(df: DataFrame, keys: list[str], ts: str, tie: str, value: Column, out: str,
              cfg: EngineConfig, largest: int | None = None) -> DataFrame:
    """`out` is the earliest non-NULL value at or after the row."""
    return _seen(df, keys, ts, tie, value, out, cfg, largest, forward=False)


def position(df: DataFrame, keys: list[str], ts: str, tie: str, out: str, cfg: EngineConfig,
             largest: int | None = None) -> DataFrame:
    """1-based place of the row in its group."""
    if not is_hot(df, keys, cfg, largest):
        number = F.row_number().over(Window.partitionBy(*keys).orderBy(ts, tie))
        return df.withColumn(out, number.cast("bigint"))
    rows = _sliced(df, ts, cfg)
    sizes = rows.groupBy(*keys, SLICE).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_carry", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    inside = Window.partitionBy(*keys, SLICE).orderBy(ts, tie)
    rows = _attach(rows.withColumn(out, F.row_number().over(inside)), sizes.drop("_n"), keys)
    return rows.withColumn(out, F.col(out) + F.col("_carry")).drop("_carry", SLICE)
