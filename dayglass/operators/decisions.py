"""Access decisions, their event fan-out, lease grants and quarantine precision.

Every decision is a function of its own session row, so the whole policy run is row-local
apart from broadcastable lookups: nothing has to be replayed in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import CAUSES, EngineConfig
from ..functions.expressions import (
    canonical_json, canonical_number, clean_nan, midnight_text, stepup_passed, unpacked,
)
from .lookup import attach

QUARANTINED = ("quarantined_after_failed_stepup", "auto_quarantined")
CONTINUED = ("stepup_flagged", "stepup_required_passed")


def decide(scored: DataFrame, cfg: EngineConfig, forced: Column | None = None) -> DataFrame:
    """Tier -> action. An unknown tier is an error; so is a session without one.

    Medium sessions continue even when the challenge fails, and a quarantined user's later
    sessions are still decided on their own merits.
    """
    tier = F.col("risk_tier")
    challenged = tier.isin("Medium", "High")
    passed = F.when(challenged, stepup_passed(F.col("user_id"), F.col("day"), cfg, forced))
    unknown = F.raise_error(F.concat(F.lit("unknown risk tier: "), F.coalesce(tier, F.lit("NULL"))))
    action = (F.when(tier == "Low", F.lit("log_only"))
              .when(tier == "Medium", F.lit("stepup_flagged"))
              .when((tier == "High") & F.col("stepup_passed"), F.lit("stepup_required_passed"))
              .when(tier == "High", F.lit("quarantined_after_failed_stepup"))
              .when(tier == "Critical", F.lit("auto_quarantined"))
              .otherwise(unknown.cast("string")))
    notes = (F.when(F.col("action") == "stepup_required_passed", F.lit("goes on, logged in detail"))
             .when(F.col("action") == "auto_quarantined",
                   F.lit("locked until a second person approves and a new lease is granted"))
             .otherwise(F.lit("")))
    return (scored.withColumn("stepup_required", F.coalesce(challenged, F.lit(False)))
            .withColumn("stepup_passed", passed)
            .withColumn("action", action)
            .withColumn("quarantined", F.col("action").isin(*QUARANTINED))
            .withColumn("notes", notes))


def decision_time(day: str = "day") -> Column:
    """Decisions are dated at the end of the session's day (event time, not the clock)."""
    return F.date_add(F.col(day), 1).cast("timestamp_ntz")


def with_lease(decisions: DataFrame, entitlements: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Continuing sessions get a short lease on their role's secret; roles without an
    entitlement get a lease on NULL, as the lookup finds nothing."""
    known = entitlements.groupBy("role").agg(F.min("secret_id").alias("secret_id"))
    go_on = F.col("action").isin(*CONTINUED)
    text = F.concat_ws("|", F.lit("lease"), F.col("user_id").cast("string"), midnight_text(F.col("day")))
    issued = decision_time()
    return (attach(decisions, known, ["role"])
            .withColumn("secret_id", F.when(go_on, F.col("secret_id")))
            .withColumn("lease_id", F.when(go_on, F.substring(F.sha2(text, 256), 1, 16)))
            .withColumn("issued_at", F.when(go_on, issued))
            .withColumn("expires_at", F.when(go_on, issued + F.make_interval(secs=F.lit(cfg.lease_ttl_seconds)))))


def lease_reason() -> Column:
    return F.concat(F.lit("challenge answered, tier "), F.col("risk_tier"))


def lease_grants(decisions: DataFrame, entitlements: DataFrame, cfg: EngineConfig) -> DataFrame:
    return (with_lease(decisions, entitlements, cfg).where(F.col("lease_id").isNotNull())
            .select("lease_id", "secret_id", "user_id", "role", "day", lease_reason().alias("reason"),
                    F.lit(cfg.lease_ttl_seconds).cast("bigint").alias("ttl_seconds"), "issued_at", "expires_at"))


def decision_events(decisions: DataFrame, entitlements: DataFrame, cfg: EngineConfig,
                    revoked: DataFrame | None = None) -> DataFrame:
    """Audit events of every decision, in order of `step_no` within a session.

    `revoked` (user_id, day, lease_ids array<string>) names leases that were live when a
    session was quarantined; such a session also logs their bulk revocation. A session emits
    at most six events, so the fan-out is a row-local explode.
    """
    rows = with_lease(decisions, entitlements, cfg)
    if revoked is None:
        rows = rows.withColumn("lease_ids", F.array().cast("array<string>"))
    else:
        rows = rows.join(revoked.select("user_id", "day", "lease_ids"), ["user_id", "day"], "left")
        rows = rows.withColumn("lease_ids", F.coalesce("lease_ids", F.array().cast("array<string>")))
    user, role, tier = F.col("user_id").cast("string"), F.col("role"), F.col("risk_tier")
    score, action = canonical_number(F.col("risk_score")), F.col("action")
    scenario = F.col("scenario_id") if "scenario_id" in rows.columns else F.lit(None).cast("string")
    if "top_features" in rows.columns:
        parts = F.transform("top_features", lambda x: F.struct(
            x["direction"].alias("direction"), x["feature"].alias("feature"),
            canonical_number(x["pct_contribution"]).alias("pct_contribution"),
            x["z_capped_for_display"].alias("z_capped_for_display"),
            canonical_number(x["z_score"]).alias("z_score")))
    else:
        parts = F.lit(None).cast("string")

    def event(name: str, when: Column, **payload: Column) -> Column:
        cell = F.struct(F.lit(name).alias("event_type"), canonical_json(**payload).alias("payload"))
        return F.when(when, cell)

    critical = action == "auto_quarantined"
    failed = action == "quarantined_after_failed_stepup"
    go_on = action.isin(*CONTINUED)
    common = {"user": user, "role": role, "risk_score": score, "tier": tier, "revoked_leases": F.col("lease_ids")}
    bulk_reason = F.when(critical, F.lit("locked out: tier Critical")).otherwise(
        F.lit("locked out: tier High, challenge failed"))
    candidates = [
        event("session_scored", F.lit(True), user=user, role=role, date=midnight_text(F.col("day")),
              risk_score=score, risk_tier=tier,
              isolation_forest_score=canonical_number(F.col("isolation_forest_score")),
              peer_group_score=canonical_number(F.col("peer_group_score"))),
        event("stepup_auth_flagged", tier == "Medium", user=user, role=role, risk_score=score),
        event("stepup_auth_required", tier == "High", user=user, role=role, risk_score=score,
              enhanced_logging=F.lit(True), top_features=parts),
        event("stepup_auth_result", F.col("stepup_required"), user=user, passed=F.col("stepup_passed"), tier=tier),
        event("leases_revoked_bulk", (critical | failed) & (F.size("lease_ids") > 0), user=user,
              lease_ids=F.col("lease_ids"), reason=bulk_reason),
        event("session_quarantined", failed, cause=F.lit(CAUSES["failed"]), **common),
        event("session_quarantined", critical, cause=F.lit(CAUSES["critical"]),
              scenario_id=scenario, **common),
        event("lease_issued", go_on, lease_id=F.col("lease_id"), secret_id=F.col("secret_id"), user=user, role=role,
              reason=lease_reason(),
              ttl_seconds=F.lit(cfg.lease_ttl_seconds),
              expires_at=F.date_format("expires_at", "yyyy-MM-dd HH:mm:ss")),
        event("lease_redeemed", go_on, lease_id=F.col("lease_id"), secret_id=F.col("secret_id"), user=user),
    ]
    emitted = F.filter(F.array(*candidates), lambda e: e.isNotNull())
    rows = rows.withColumn("event_time", F.date_format(decision_time(), "yyyy-MM-dd HH:mm:ss"))
    return unpacked(rows, ["user_id", "day", "event_time"], emitted)


def quarantine_precision(decisions: DataFrame, labels: DataFrame) -> DataFrame:
    """How many of the locked-out sessions were malicious, all and Critical only."""
    truth = labels.where("is_malicious").select("user_id", "day").distinct().withColumn("hit", F.lit(True))
    rows = (decisions.where("quarantined").select("user_id", "day", "action")
            .join(truth, ["user_id", "day"], "left"))
    hit, critical = F.col("hit").isNotNull(), F.col("action") == "auto_quarantined"
    counts = rows.agg(
        F.count("*").alias("n_quarantined"), F.count_if(hit).alias("n_malicious_quarantined"),
        F.count_if(critical).alias("n_critical_only"),
        F.count_if(critical & hit).alias("n_malicious_critical_only"),
        F.count_if(~critical).alias("n_escalated_high"))
    return (counts
            .withColumn("blended_precision", F.try_divide("n_malicious_quarantined", "n_quarantined"))
            .withColumn("critical_only_precision", F.try_divide("n_malicious_critical_only", "n_critical_only")))


def first_quarantines(decisions: DataFrame, n: int = 10) -> DataFrame:
    return (decisions.where("quarantined").orderBy("day", "user_id").limit(n)
            .select("user_id", "role", "day", "risk_tier", "risk_score", "action"))


def scored_cleaned(scored: DataFrame) -> DataFrame:
    """NaN scores as NULL, so that no NaN reaches a ledger."""
    names = [c for c, kind in scored.dtypes if kind == "double"]
    return scored.withColumns({c: clean_nan(F.col(c)) for c in names})
