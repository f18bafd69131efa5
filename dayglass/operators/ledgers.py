"""Lease and quarantine ledgers in closed form.

The lifecycle rules look sequential, but each outcome depends only on a few firsts: the first
redemption attempt, the first revoke and the first bulk revoke after issue. Those are `min`
aggregates and next-seen lookups, so a ledger of any length is settled without replaying it
and without pairing a user's leases with that user's events.

Inputs (ordered by time, then id):
  grants(lease_id, user_id, issued_at, issued_ord, expires_at)
  attempts(attempt_id, at, lease_id)      lease_id may be NULL or unknown
  revokes(revoke_id, at, lease_id)        bulk(bulk_id, at, user_id)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import CAUSES, EngineConfig
from ..functions.expressions import canonical_json, unpacked
from . import timeline
from .lookup import attach

MOMENT = "struct<at: timestamp_ntz, id: bigint>"


def _moment(at: str, ident: str) -> Column:
    return F.struct(F.col(at).alias("at"), F.col(ident).alias("id")).cast(MOMENT)


def _first_bulk(grants: DataFrame, bulk: DataFrame, cfg: EngineConfig) -> DataFrame:
    """For each lease the first bulk revoke after issue that finds it unexpired. Only that one
    can matter: it ends the lease, or finds it ended already."""
    rows = grants.select("user_id", F.col("issued_at").alias("at"), F.col("issued_ord").alias("ord"),
                         "lease_id", "expires_at").unionByName(
        bulk.select("user_id", "at", F.col("bulk_id").alias("ord")), allowMissingColumns=True)
    hit = F.when(F.col("lease_id").isNull(), _moment("at", "ord"))
    rows = timeline.next_seen(rows, ["user_id"], "at", "ord", hit, "bulk", cfg).where("lease_id IS NOT NULL")
    return rows.select("lease_id", F.when(F.col("bulk.at") <= F.col("expires_at"), F.col("bulk")).alias("bulk"))


def lease_states(grants: DataFrame, attempts: DataFrame, revokes: DataFrame, bulk: DataFrame,
                 cfg: EngineConfig) -> DataFrame:
    """One row per lease: `redeemed` and `revoked` moments (at most one is set) and, for a
    revoked lease, whether a bulk revoke did it.

    One union and one aggregate on lease_id; minima merge map-side, so a lease with very many
    attempts is no hot spot.
    """
    marks = [
        grants.select("lease_id", "user_id", "issued_at", "issued_ord", "expires_at"),
        attempts.where(F.col("lease_id").isNotNull())
                .select("lease_id", _moment("at", "attempt_id").alias("attempt")),
        revokes.select("lease_id", _moment("at", "revoke_id").alias("single")),
        _first_bulk(grants, bulk, cfg),
    ]
    rows = marks[0]
    for m in marks[1:]:
        rows = rows.unionByName(m, allowMissingColumns=True)
    lease = rows.groupBy("lease_id").agg(
        *[F.max(c).alias(c) for c in ("user_id", "issued_at", "issued_ord", "expires_at")],
        F.min("attempt").alias("attempt"), F.min("single").alias("single"), F.min("bulk").alias("bulk"),
    ).where(F.col("issued_at").isNotNull())
    valid = F.when(F.col("attempt.at") <= F.col("expires_at"), F.col("attempt"))
    revoke = F.least("single", "bulk")
    redeemed = F.when(valid.isNotNull() & (revoke.isNull() | (valid < revoke)), valid)
    lease = lease.withColumn("redeemed", redeemed)
    lease = lease.withColumn("revoked", F.when(F.col("redeemed").isNull(), revoke))
    by_bulk = F.col("revoked").isNotNull() & F.col("bulk").isNotNull() & (F.col("revoked") == F.col("bulk"))
    return lease.select("lease_id", "user_id", "issued_at", "expires_at", "redeemed", "revoked",
                        by_bulk.alias("by_bulk"))


def redeem_outcomes(attempts: DataFrame, states: DataFrame) -> DataFrame:
    """Every attempt with its outcome; a denial names revocation before reuse before expiry."""
    me = _moment("at", "attempt_id")
    rows = attempts.join(states.select("lease_id", "expires_at", "redeemed", "revoked"), "lease_id", "left")
    outcome = (F.when(F.col("expires_at").isNull(), F.lit("unknown"))
               .when(F.col("revoked") < me, F.lit("revoked"))
               .when(F.col("redeemed") < me, F.lit("already_redeemed"))
               .when(F.col("redeemed") == me, F.lit("redeemed"))
               .otherwise(F.lit("expired")))
    return rows.select("attempt_id", "at", "lease_id", outcome.alias("outcome"))


def revoke_outcomes(revokes: DataFrame, states: DataFrame) -> DataFrame:
    """Whether a single revoke took effect. Expired leases may still be revoked."""
    rows = revokes.join(states.select("lease_id", "revoked"), "lease_id", "left")
    done = F.coalesce(F.col("revoked") == _moment("at", "revoke_id"), F.lit(False))
    return rows.select("revoke_id", "at", "lease_id", done.alias("effective"))


def bulk_revoked_leases(states: DataFrame) -> DataFrame:
    """(bulk_id, user_id, lease_id): the leases each bulk revoke ended, one row per lease."""
    return (states.where("by_bulk")
            .select(F.col("revoked.id").alias("bulk_id"), "user_id", "lease_id"))


def live_leases(states: DataFrame, at: Column) -> DataFrame:
    """Leases neither redeemed, revoked nor expired at a moment."""
    later = lambda c: F.col(f"{c}.at").isNull() | (F.col(f"{c}.at") > at)
    return (states.where((F.col("issued_at") <= at) & (at <= F.col("expires_at")) & later("redeemed") & later("revoked"))
            .select("lease_id", "user_id", "issued_at", "expires_at"))


def ledger_events(grants: DataFrame, attempts: DataFrame, revokes: DataFrame, bulk: DataFrame, states: DataFrame,
                  directory: DataFrame, entitlements: DataFrame) -> DataFrame:
    """The audit events of a lease ledger in one total order (at, ord): user_id, day, at, ord,
    event_time, event_type, payload.

    Every grant, every redemption (or its denial, with the cause) and every single revoke, with
    effect or without, is an event, and each bulk revoke that ended any lease. Attempts and revokes
    of unknown leases leave none. The four inputs are sorted by time and id alike, so the merge is
    a union: (at, ord) is the order, wherever a row lies. Attempts need user_id.
    """
    named = attach(with_role(grants, directory), entitlements.groupBy("role").agg(F.min("secret_id").alias("secret_id")), ["role"])
    owner = states.select("lease_id", F.col("user_id").alias("owner"), "redeemed", "revoked")
    user = F.col("user_id").cast("string")
    lease = F.col("lease_id").cast("string")
    ttl = F.unix_micros(F.col("expires_at").cast("timestamp")) - F.unix_micros(F.col("issued_at").cast("timestamp"))

    def events(rows: DataFrame, at: str, ident: str, name: Column, payload: Column) -> DataFrame:
        return rows.select("user_id", F.col(at).alias("at"), F.col(ident).alias("ord"), name.alias("event_type"), payload.alias("payload"))

    issued = events(named, "issued_at", "issued_ord", F.lit("lease_issued"), canonical_json(
        lease_id=lease, secret_id=F.col("secret_id"), user=user, role=F.col("role"), reason=F.lit("granted on request"),
        ttl_seconds=F.floor(ttl / 1_000_000), expires_at=F.date_format("expires_at", "yyyy-MM-dd HH:mm:ss")))
    tried = redeem_outcomes(attempts, states).where("outcome <> 'unknown'").join(
        attempts.select("attempt_id", "user_id"), "attempt_id").join(named.select("lease_id", "secret_id"), "lease_id", "left")
    done = F.col("outcome") == "redeemed"
    redeemed = events(
        tried, "at", "attempt_id", F.when(done, F.lit("lease_redeemed")).otherwise(F.lit("lease_redeem_denied")),
        F.when(done, canonical_json(lease_id=lease, secret_id=F.col("secret_id"), user=user)).otherwise(
            canonical_json(lease_id=lease, cause=F.col("outcome"))))
    single = events(
        revokes.select("revoke_id", "at", "lease_id").join(owner.select("lease_id", F.col("owner").alias("user_id"), "revoked"), "lease_id"),
        "at", "revoke_id", F.lit("lease_revoked"), canonical_json(
            lease_id=lease, reason=F.when(F.col("revoked") == _moment("at", "revoke_id"), F.lit("withdrawn")).otherwise(F.lit("withdrawn, no effect"))))
    ended = bulk_revoked_leases(states).join(grants.select("lease_id", "issued_at", "issued_ord"), "lease_id").groupBy("bulk_id", "user_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("issued_at", "issued_ord", "lease_id"))), lambda x: x["lease_id"].cast("string")).alias("lease_ids"))
    whole = events(bulk.join(ended, ["bulk_id", "user_id"]), "at", "bulk_id", F.lit("leases_revoked_bulk"), canonical_json(
        user=user, lease_ids=F.col("lease_ids"), reason=F.lit("all leases withdrawn")))
    merged = issued.unionByName(redeemed).unionByName(single).unionByName(whole)
    return merged.withColumns({"day": F.col("at").cast("date"), "event_time": F.date_format("at", "yyyy-MM-dd HH:mm:ss")})


# ---- quarantine --------------------------------------------------------------------------
# quarantines(quarantine_id, at, user_id, reason)   requests(request_id, at, user_id, approver)
def resume_outcomes(quarantines: DataFrame, requests: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Maker-checker: each request is approved, denied or finds nothing to release.

    A quarantine opens a segment that the first valid request closes. So a request needs only
    the latest quarantine at or before it and the first valid request of that segment.
    """
    opened = quarantines.select("user_id", "at", F.col("quarantine_id").alias("ord"), F.lit(True).alias("opens"))
    asked = requests.select("user_id", "at", F.col("request_id").alias("ord"), F.lit(False).alias("opens"), "approver")
    rows = opened.unionByName(asked, allowMissingColumns=True)
    start = F.when(F.col("opens"), F.col("ord"))
    rows = timeline.last_seen(rows, ["user_id"], "at", "ord", start, "segment", cfg).where("NOT opens")
    named = F.coalesce((F.col("approver") != "") & (F.col("approver") != F.col("user_id").cast("string")), F.lit(False))
    rows = rows.withColumn("named", named)
    closing = (rows.where("named AND segment IS NOT NULL").groupBy("user_id", "segment")
               .agg(F.min(_moment("at", "ord")).alias("closed")))
    rows = rows.join(closing, ["user_id", "segment"], "left")
    me = _moment("at", "ord")
    outcome = (F.when(F.col("segment").isNull() | (F.col("closed") < me), F.lit("not_quarantined"))
               .when(F.col("closed") == me, F.lit("approved"))
               .otherwise(F.lit("denied_missing_or_self")))
    return rows.select(F.col("ord").alias("request_id"), "at", "user_id", "approver",
                       F.col("segment").alias("quarantine_id"), outcome.alias("outcome"))


def quarantine_ledger(quarantines: DataFrame, outcomes: DataFrame, directory: DataFrame | None = None) -> DataFrame:
    """The latest quarantine of each user and who released it, if anyone did."""
    latest = quarantines.groupBy("user_id").agg(
        F.max(F.struct("at", "quarantine_id", "reason")).alias("q"), F.count("*").alias("n_quarantines"))
    latest = latest.select("user_id", "n_quarantines", "q.quarantine_id", F.col("q.at").alias("quarantined_at"), "q.reason")
    freed = outcomes.where("outcome = 'approved'").select(
        "user_id", "quarantine_id", F.col("at").alias("released_at"), F.col("approver").alias("released_by"))
    ledger = latest.join(freed, ["user_id", "quarantine_id"], "left").withColumn("active", F.col("released_at").isNull())
    return ledger if directory is None else with_role(ledger, directory)


def with_role(df: DataFrame, directory: DataFrame) -> DataFrame:
    """Users missing from the directory get the role 'Unknown'."""
    return (df.join(directory.select("user_id", "role"), "user_id", "left")
            .withColumn("role", F.coalesce("role", F.lit("Unknown"))))


def active_quarantines(ledger: DataFrame) -> DataFrame:
    return ledger.where("active")


def resume_lease_id() -> Column:
    return F.substring(F.sha2(F.concat_ws("|", F.lit("resume"), F.col("request_id").cast("string")), 256), 1, 16)


def resume_leases(outcomes: DataFrame, cfg: EngineConfig, ttl_seconds: int | None = None) -> DataFrame:
    """The leases that approvals grant, as `lease_states` takes them."""
    ttl = cfg.lease_ttl_seconds if ttl_seconds is None else ttl_seconds
    return outcomes.where("outcome = 'approved'").select(
        resume_lease_id().alias("lease_id"), "user_id", F.col("at").alias("issued_at"), F.col("request_id").alias("issued_ord"),
        (F.col("at") + F.make_interval(secs=F.lit(ttl))).alias("expires_at"))


def resume_events(outcomes: DataFrame, directory: DataFrame, entitlements: DataFrame, cfg: EngineConfig,
                  ttl_seconds: int | None = None) -> DataFrame:
    """Audit events of the requests: none, one (denied) or three (approval, lease, release)."""
    ttl = cfg.lease_ttl_seconds if ttl_seconds is None else ttl_seconds
    rows = attach(with_role(outcomes, directory), entitlements.groupBy("role").agg(F.min("secret_id").alias("secret_id")), ["role"])
    user, approver = F.col("user_id").cast("string"), F.col("approver")
    lease = resume_lease_id()
    expires = F.date_format(F.col("at") + F.make_interval(secs=F.lit(ttl)), "yyyy-MM-dd HH:mm:ss")

    def event(name: str, outcome: str, **payload: Column) -> Column:
        cell = F.struct(F.lit(name).alias("event_type"), canonical_json(**payload).alias("payload"))
        return F.when(F.col("outcome") == outcome, cell)

    emitted = F.filter(F.array(
        event("second_person_approval_denied", "denied_missing_or_self", user=user, approver=approver,
              cause=F.lit(CAUSES["approval"])),
        event("second_person_approval", "approved", user=user, role=F.col("role"), approver=approver),
        event("lease_issued", "approved", lease_id=lease, secret_id=F.col("secret_id"), user=user, role=F.col("role"),
              reason=F.concat(F.lit("release approved by "), approver), ttl_seconds=F.lit(ttl),
              expires_at=expires),
        event("quarantine_released", "approved", user=user, approved_by=approver, lease_id=lease),
    ), lambda e: e.isNotNull())
    rows = rows.withColumns({"day": F.col("at").cast("date"),
                             "event_time": F.date_format("at", "yyyy-MM-dd HH:mm:ss")})
    return unpacked(rows, ["request_id", "user_id", "day", "event_time"], emitted)
