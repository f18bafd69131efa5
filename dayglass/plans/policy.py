"""The policy from scored sessions to locks and back: decide, quarantine, release, audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import EngineConfig
from ..operators import ledgers, lockouts
from ..operators.decisions import decide, decision_events, lease_grants, scored_cleaned
from ..session import materialize

REQUESTS = "request_id bigint, at timestamp_ntz, user_id {kind}, approver string"


def run_policy(scored: DataFrame, entitlements: DataFrame, cfg: EngineConfig, requests: DataFrame | None = None) -> dict[str, DataFrame]:
    """What a batch of sessions and requests to resume leads to.

    decisions (with locked and locked_since), events, grants, rejects (sessions without a tier,
    which are not decided), quarantines, outcomes (of the requests) and intervals (of locks). A
    release grants a lease; one that is still live when its user is locked out again is revoked,
    and the session's events say so. Events are ordered by day, user_id and step_no.
    """
    sessions = scored_cleaned(scored)
    tiered = F.col("risk_tier").isNotNull()
    decisions = decide(sessions.where(tiered), cfg)
    quarantines = materialize(lockouts.quarantines_of(decisions), "quarantines")  # few rows, read many times
    if requests is None:
        spark, kind = scored.sparkSession, dict(scored.dtypes)["user_id"]
        requests = spark.createDataFrame([], REQUESTS.format(kind=kind))
    requests = materialize(requests, "requests")  # may be a selection from a large log, and is read several times
    outcomes = materialize(ledgers.resume_outcomes(quarantines, requests, cfg), "resume-outcomes")
    nothing = outcomes.where("false")
    states = ledgers.lease_states(
        ledgers.resume_leases(outcomes, cfg), nothing.select(F.col("request_id").alias("attempt_id"), "at", ledgers.resume_lease_id().alias("lease_id")),
        nothing.select(F.col("request_id").alias("revoke_id"), "at", ledgers.resume_lease_id().alias("lease_id")),
        quarantines.select(F.col("quarantine_id").alias("bulk_id"), "at", "user_id"), cfg)
    revoked = ledgers.bulk_revoked_leases(states).groupBy("user_id", F.date_from_unix_date(F.col("bulk_id").cast("int")).alias("day")).agg(
        F.sort_array(F.collect_list("lease_id")).alias("lease_ids"))
    intervals = lockouts.lock_intervals(quarantines, outcomes, cfg)
    return {"decisions": lockouts.with_lock(decisions, intervals, cfg), "events": decision_events(decisions, entitlements, cfg, revoked),
            "grants": lease_grants(decisions, entitlements, cfg), "rejects": sessions.where(~tiered),
            "quarantines": quarantines, "outcomes": outcomes, "intervals": intervals.drop("first_id")}
