"""Row-local expressions: every function takes and returns Spark columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, functions as F

from ..config import ACTION_LABELS, EngineConfig

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


# ---- time ------------------------------------------------------------------------------
def calendar_day(ts: str) -> Column:
    return F.to_date(F.col(ts))


def hour_of_day(ts: str) -> Column:
    return F.hour(F.col(ts))


def day_of_week(day: str) -> Column:
    """Monday is 0."""
    return F.weekday(F.col(day))


def epoch_micros(ts: str) -> Column:
    """Microseconds since 1970 of a zone-free timestamp (no session time zone involved)."""
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, CAST({ts} AS TIMESTAMP_NTZ))")


def split_of(day: str, cfg: EngineConfig) -> Column:
    return F.when(F.col(day) < F.lit(cfg.split_day), F.lit("train")).otherwise(F.lit("test"))


# ---- entropy and shares ------------------------------------------------------------------
def entropy_terms(counts: Sequence[Column]) -> tuple[Column, Column]:
    """n and sum(c log2 c) of a bag given by its counts."""
    spread = [F.coalesce(c * F.log2(c), F.lit(0.0)) for c in counts]
    return reduce(add, counts).cast("double"), reduce(add, spread)


def entropy_bits(n: Column, spread: Column) -> Column:
    """Shannon entropy log2(n) - sum(c log2 c)/n; an empty bag is 0."""
    return F.when(n > 0, F.greatest(F.log2(n) - spread / n, F.lit(0.0))).otherwise(F.lit(0.0))


def share(part: Column, whole: Column) -> Column:
    return F.coalesce(part / F.nullif(whole.cast("double"), F.lit(0.0)), F.lit(0.0))


# ---- arrays ------------------------------------------------------------------------------
def unpacked(df: DataFrame, keep: Sequence[str], array: Column, place: str = "step_no") -> DataFrame:
    """One row per element of a computed array: the kept columns, its place and its fields.

    A plain explode makes the planner test the array's size in a filter of its own, which
    repeats the whole computation of the array; the outer form does not.
    """
    rows = df.select(*keep, F.posexplode_outer(array).alias("_pos", "_cell")).where(F.col("_pos").isNotNull())
    return rows.select(*keep, F.col("_pos").cast("bigint").alias(place), "_cell.*")


# ---- scores ------------------------------------------------------------------------------
def compress_z(z: Column, threshold: float) -> Column:
    """Keep |z| up to the threshold, let it grow only logarithmically beyond."""
    soft = F.signum(z) * (F.lit(threshold) + F.log1p(F.abs(z) - threshold))
    return F.when(F.abs(z) > threshold, soft).otherwise(z)


def excess_score(raw: Column, baseline: Column, scale: Column, k: float) -> Column:
    """0 at or below the baseline, saturating towards 100 above it."""
    units = F.greatest(raw - baseline, F.lit(0.0)) / (F.lit(k) * F.greatest(scale, F.lit(1e-9)))
    score = F.lit(100.0) * (F.lit(1.0) - F.exp(-units))
    return F.greatest(F.least(score, F.lit(100.0)), F.lit(0.0))


def blend(forest: Column, peer: Column, cfg: EngineConfig) -> Column:
    both = F.lit(cfg.forest_weight) * forest + F.lit(cfg.peer_weight) * peer
    return F.coalesce(both, forest) if cfg.allow_partial else both


def risk_tier(score: Column, cfg: EngineConfig) -> Column:
    """Half-open ranges; NaN and out-of-range scores take the last label, NULL stays NULL."""
    first, *rest = cfg.tiers
    chain = F.when((score >= first[0]) & (score < first[1]), F.lit(first[2]))
    for low, high, label in rest:
        chain = chain.when((score >= low) & (score < high), F.lit(label))
    return F.when(score.isNotNull(), chain.otherwise(F.lit(cfg.tiers[-1][2])))


def clean_nan(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


# ---- decisions ---------------------------------------------------------------------------
def midnight_text(day: Column) -> Column:
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" 00:00:00"))


def first_byte(text: Column) -> Column:
    return F.conv(F.substring(F.sha2(text, 256), 1, 2), 16, 10).cast("int")


def stepup_passed(user: Column, day: Column, cfg: EngineConfig, forced: Column | None = None) -> Column:
    """Deterministic challenge outcome: a hash of (user, day) against the pass rate."""
    digest = first_byte(F.concat_ws("|", user.cast("string"), midnight_text(day)))
    drawn = digest / F.lit(255.0) < F.lit(cfg.stepup_pass_rate)
    return drawn if forced is None else F.coalesce(forced, drawn)


def action_label(action: Column) -> Column:
    (code, text), *rest = ACTION_LABELS
    chain = F.when(action == code, F.lit(text))
    for code, text in rest:
        chain = chain.when(action == code, F.lit(text))
    return chain.otherwise(action)


# ---- canonical text ----------------------------------------------------------------------
def canonical_number(x: Column) -> Column:
    """Same text in any engine: six decimals, never an exponent, NaN as NULL."""
    return F.round(clean_nan(x), 6).cast("decimal(18,6)").cast("string")


def canonical_json(**fields: Column) -> Column:
    """Compact JSON text with keys in sorted order and NULLs kept."""
    ordered = [fields[name].alias(name) for name in sorted(fields)]
    return F.to_json(F.struct(*ordered), {"ignoreNullFields": "false"})
