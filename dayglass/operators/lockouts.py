"""Lockouts: how the policy's quarantines and the approvals that end them become intervals.

A user is locked from the first quarantine after a release until the next approval by a second
person; further quarantines in between renew the lock. One ordered pass over a user's quarantines
and approvals finds, for each quarantine, the approval that follows. Quarantines with the same one
make an interval, so an interval is an aggregate, and whether a session met a lock is a look at
the last mark before it. A lock does not stop later sessions from being decided; it is reported.

At one instant sessions come first, then the marks by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import CAUSES, EngineConfig
from . import timeline
from .decisions import QUARANTINED, decision_time

MARK = "struct<locked: boolean, since: timestamp_ntz>"


def quarantines_of(decisions: DataFrame) -> DataFrame:
    """One row for each decision that locks its user out. A user has one session a day, so the
    day's number identifies the quarantine among the user's."""
    critical = F.col("action") == QUARANTINED[1]
    scenario = F.col("scenario_id") if "scenario_id" in decisions.columns else F.lit(None).cast("string")
    reason = F.when(critical, F.concat(F.lit("tier Critical, scenario "), F.coalesce(scenario, F.lit("unnamed")))).otherwise(
        F.lit("tier High, challenge failed"))
    return decisions.where("quarantined").select(
        "user_id", F.unix_date("day").cast("bigint").alias("quarantine_id"), decision_time().alias("at"), "day",
        F.when(critical, F.lit(CAUSES["critical"])).otherwise(F.lit(CAUSES["failed"])).alias("cause"), reason.alias("reason"))


def lock_intervals(quarantines: DataFrame, outcomes: DataFrame, cfg: EngineConfig) -> DataFrame:
    """user_id, locked_from, locked_until (null while locked), n_quarantines, the latest one's
    quarantine_id and reason, request_id and released_by."""
    released = outcomes.where("outcome = 'approved'").select(
        "user_id", "at", F.col("request_id").alias("ord"), F.struct("at", F.col("request_id").alias("id"), "approver").alias("release"))
    locked = quarantines.select("user_id", "at", F.col("quarantine_id").alias("ord"), "reason")
    rows = timeline.next_seen(locked.unionByName(released, allowMissingColumns=True), ["user_id"], "at", "ord", F.col("release"), "until", cfg)
    return rows.where("release IS NULL").groupBy("user_id", "until").agg(
        F.min(F.struct("at", "ord")).alias("first"), F.max(F.struct("at", "ord", "reason")).alias("last"), F.count("*").alias("n_quarantines")).select(
        "user_id", F.col("first.at").alias("locked_from"), F.col("until.at").alias("locked_until"), "n_quarantines",
        F.col("last.ord").alias("quarantine_id"), F.col("last.reason").alias("reason"), F.col("until.id").alias("request_id"),
        F.col("until.approver").alias("released_by"), F.col("first.ord").alias("first_id"))


def _mark(locked: bool, since: Column) -> Column:
    return F.struct(F.lit(locked).alias("locked"), since.alias("since")).cast(MARK)


def with_lock(sessions: DataFrame, intervals: DataFrame, cfg: EngineConfig) -> DataFrame:
    """`sessions` (user_id, day and more) with locked (was the user locked out just before the
    decision?) and locked_since."""
    nobody = F.lit(None).cast("timestamp_ntz")
    opens = intervals.select("user_id", F.col("locked_from").alias("_at"), F.col("first_id").alias("_ord"), _mark(True, F.col("locked_from")).alias("_mark"))
    ends = intervals.where("locked_until IS NOT NULL").select(
        "user_id", F.col("locked_until").alias("_at"), F.col("request_id").alias("_ord"), _mark(False, nobody).alias("_mark"))
    marks = opens.unionByName(ends).withColumn("_tie", F.struct(F.lit(1).alias("kind"), F.col("_ord").alias("ord"))).drop("_ord")
    own = sessions.withColumns({"_at": decision_time(), "_tie": F.struct(F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("ord")),
                                "_mark": F.lit(None).cast(MARK), "_own": F.lit(True)})
    rows = timeline.last_seen(own.unionByName(marks, allowMissingColumns=True), ["user_id"], "_at", "_tie", F.col("_mark"), "_state", cfg)
    return rows.where("_own").withColumns({"locked": F.coalesce("_state.locked", F.lit(False)), "locked_since": F.col("_state.since")}).drop(
        "_at", "_tie", "_mark", "_own", "_state")
