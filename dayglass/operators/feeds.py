"""Read-side queries over scored sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.expressions import action_label, unpacked

FEED_TIERS = ("Medium", "High", "Critical")


def session_feed(decisions: DataFrame, tiers=FEED_TIERS) -> DataFrame:
    """Sessions of the chosen tiers with their outcome in words."""
    return decisions.where(F.col("risk_tier").isin(*tiers)).select(
        "day", "user_id", "role", F.round("risk_score", 1).alias("risk_score"), "risk_tier",
        action_label(F.col("action")).alias("outcome"))


def high_risk(scored: DataFrame) -> DataFrame:
    return scored.where(F.col("risk_tier").isin("High", "Critical"))


def held_out(scored: DataFrame) -> DataFrame:
    return scored.where("split = 'test'").orderBy("day", "user_id")


def top_sessions(scored: DataFrame, n: int = 15) -> DataFrame:
    return scored.orderBy(F.col("risk_score").desc(), "user_id", "day").limit(n)


def labelled_sessions(scored: DataFrame) -> DataFrame:
    return scored.where("is_malicious").orderBy(F.col("risk_score").desc(), "user_id", "day")


def drilldown(scored: DataFrame, user_id=None, day=None) -> DataFrame:
    """Explanation rows, of one session when its key is given."""
    if user_id is not None:
        scored = scored.where((F.col("user_id") == user_id) & (F.col("day") == F.lit(day)))
    return unpacked(scored, ["user_id", "day", "risk_score", "risk_tier"], F.col("top_features"), "place")
