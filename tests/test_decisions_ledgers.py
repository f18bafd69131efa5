"""Decisions by rule, ledgers against a replaying loop."""

import datetime as dt
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from dayglass.operators import decisions, feeds, ledgers, lockouts
from dayglass.plans import policy

DAY = dt.date(2024, 1, 20)
SCORED = ("user_id string, role string, day date, split string, is_malicious boolean, scenario_id string, risk_score double, "
          "risk_tier string, isolation_forest_score double, peer_group_score double")


@pytest.fixture(scope="module")
def scored(spark):
    rows = []
    for i in range(120):
        tier, score = [("Low", 10.0), ("Medium", 50.0), ("High", 70.0), ("Critical", 90.0)][i % 4]
        rows.append((f"u{i}", "DBA" if i % 8 < 6 else "SOC", DAY, "test", i % 5 == 0, "S" if i % 5 == 0 else None, score, tier, score, score))
    return spark.createDataFrame(rows, SCORED)


@pytest.fixture(scope="module")
def ent(spark):
    return spark.createDataFrame([("DBA", "core-db")], "role string, secret_id string")


def passes(user):
    return hashlib.sha256(f"{user}|{DAY} 00:00:00".encode()).digest()[0] / 255 < 0.97


def test_decision_rules(scored, cfg):
    got = {r.user_id: r for r in decisions.decide(scored, cfg).collect()}
    for i in range(120):
        r = got[f"u{i}"]
        if i % 4 == 0:
            assert (r.action, r.stepup_passed, r.quarantined) == ("log_only", None, False)
        elif i % 4 == 1:
            assert r.action == "stepup_flagged" and r.stepup_passed == passes(r.user_id) and not r.quarantined
        elif i % 4 == 2:
            assert r.action == ("stepup_required_passed" if passes(r.user_id) else "quarantined_after_failed_stepup")
        else:
            assert r.action == "auto_quarantined" and r.quarantined and not r.stepup_required


def test_forced_outcome_and_fan_out(scored, ent, cfg):
    made = decisions.decide(scored, cfg, forced=F.lit(False))
    assert made.where("action = 'quarantined_after_failed_stepup'").count() == 30
    assert made.where("action = 'stepup_flagged'").count() == 30  # Medium goes on regardless
    events = decisions.decision_events(made, ent, cfg)
    # Low 1, Medium 5, High failed 4, Critical 2
    assert events.count() == 30 * (1 + 5 + 4 + 2)
    passed = decisions.decision_events(decisions.decide(scored, cfg, forced=F.lit(True)), ent, cfg)
    assert passed.count() == 30 * (1 + 5 + 5 + 2)
    for r in passed.collect():
        payload = json.loads(r.payload)
        assert list(payload) == sorted(payload) and payload["user"] == r.user_id
        if r.event_type == "lease_issued":
            assert payload["secret_id"] in ("core-db", None)


def test_bulk_revocation_is_logged_when_leases_were_live(spark, scored, ent, cfg):
    live = spark.createDataFrame([("u3", DAY, ["l1", "l2"])], "user_id string, day date, lease_ids array<string>")
    events = decisions.decision_events(decisions.decide(scored, cfg), ent, cfg, live).where("user_id = 'u3'").orderBy("step_no").collect()
    assert [e.event_type for e in events] == ["session_scored", "leases_revoked_bulk", "session_quarantined"]
    assert json.loads(events[2].payload)["revoked_leases"] == ["l1", "l2"]


@pytest.mark.parametrize("tier", ["Severe", None])
def test_unknown_tier_is_an_error(scored, cfg, tier):
    bad = scored.limit(1).withColumn("risk_tier", F.lit(tier).cast("string"))
    with pytest.raises(Exception, match="unknown risk tier"):
        decisions.decide(bad, cfg).collect()


def test_policy_run_hands_back_unscored_sessions(scored, ent, cfg):
    lost = F.col("user_id") == "u3"
    mixed = scored.withColumn("risk_tier", F.when(~lost, F.col("risk_tier"))).withColumn(
        "risk_score", F.when(lost, F.lit(float("nan"))).otherwise(F.col("risk_score")))
    out = policy.run_policy(mixed, ent, cfg)
    assert [(r.user_id, r.risk_score) for r in out["rejects"].collect()] == [("u3", None)]
    assert out["decisions"].count() == 119 and out["events"].where("user_id = 'u3'").count() == 0


def test_precision(scored, cfg, spark):
    made = decisions.decide(scored, cfg, forced=F.lit(False))
    row = decisions.quarantine_precision(made, scored).first()
    assert (row.n_quarantined, row.n_critical_only, row.n_escalated_high) == (60, 30, 30)
    assert row.blended_precision == pytest.approx(row.n_malicious_quarantined / 60)
    none = decisions.quarantine_precision(made.where("false"), scored).first()
    assert none.n_quarantined == 0 and none.blended_precision is None


def test_feed_words(scored, cfg):
    feed = feeds.session_feed(decisions.decide(scored, cfg))
    assert feed.where("risk_tier = 'Low'").count() == 0
    assert {r.outcome for r in feed.where("risk_tier = 'Critical'").collect()} == {"Auto-quarantined"}


# ---- ledgers -------------------------------------------------------------------------------
T0 = dt.datetime(2024, 1, 1)


def make_ledger(seed, users=6, n=700):
    rng = random.Random(seed)
    events, leases = [], {}
    for i in range(n):
        user = 1 if rng.random() < 0.4 else rng.randrange(users)
        at = T0 + dt.timedelta(minutes=i // 3)  # several events share an instant
        kind = rng.choice(["grant", "redeem", "redeem", "revoke", "bulk", "quarantine", "resume"])
        mine = leases.setdefault(user, [])
        lease = rng.choice(mine) if mine and rng.random() < 0.9 else None
        e = {"id": i, "user": user, "at": at, "kind": kind, "lease": lease}
        if kind == "grant":
            mine.append(i)
            e["expires"] = at + dt.timedelta(minutes=rng.randrange(1, 120))
        if kind == "revoke" and lease is None:
            continue
        if kind == "resume":
            e["approver"] = rng.choice(["", str(user), "boss", None])
        events.append(e)
    return events


def replay(events):
    """The lifecycle rules, one event after the other."""
    leases, locked, out = {}, set(), {"redeem": {}, "revoke": {}, "bulk": set(), "resume": {}}
    for e in events:
        lease = leases.get(e["lease"])
        if e["kind"] == "grant":
            leases[e["id"]] = {"user": e["user"], "expires": e["expires"], "status": "live"}
        elif e["kind"] == "redeem":
            if lease is None:
                out["redeem"][e["id"]] = "unknown"
            elif lease["status"] != "live":
                out["redeem"][e["id"]] = {"revoked": "revoked", "redeemed": "already_redeemed"}[lease["status"]]
            elif e["at"] > lease["expires"]:
                out["redeem"][e["id"]] = "expired"
            else:
                lease["status"] = out["redeem"][e["id"]] = "redeemed"
        elif e["kind"] == "revoke":
            out["revoke"][e["id"]] = lease["status"] == "live"
            if lease["status"] == "live":
                lease["status"] = "revoked"
        elif e["kind"] == "bulk":
            for k, v in leases.items():
                if v["user"] == e["user"] and v["status"] == "live" and e["at"] <= v["expires"]:
                    v["status"] = "revoked"
                    out["bulk"].add((e["id"], k))
        elif e["kind"] == "quarantine":
            locked.add(e["user"])
        elif e["user"] not in locked:
            out["resume"][e["id"]] = "not_quarantined"
        elif not e["approver"] or e["approver"] == str(e["user"]):
            out["resume"][e["id"]] = "denied_missing_or_self"
        else:
            out["resume"][e["id"]] = "approved"
            locked.discard(e["user"])
    return out, locked, leases


def frames(spark, events):
    def frame(kind, schema, *fields):
        return spark.createDataFrame([tuple(e.get(f) for f in fields) for e in events if e["kind"] == kind], schema)

    ts = "timestamp_ntz"
    return {
        "grants": frame("grant", f"lease_id bigint, user_id bigint, issued_at {ts}, issued_ord bigint, expires_at {ts}", "id", "user", "at", "id", "expires"),
        "attempts": frame("redeem", f"attempt_id bigint, at {ts}, lease_id bigint", "id", "at", "lease"),
        "revokes": frame("revoke", f"revoke_id bigint, at {ts}, lease_id bigint", "id", "at", "lease"),
        "bulk": frame("bulk", f"bulk_id bigint, at {ts}, user_id bigint", "id", "at", "user"),
        "quarantines": frame("quarantine", f"quarantine_id bigint, at {ts}, user_id bigint, reason string", "id", "at", "user", "kind"),
        "requests": frame("resume", f"request_id bigint, at {ts}, user_id bigint, approver string", "id", "at", "user", "approver"),
    }


@pytest.mark.parametrize("hot_rows", [10**9, 5])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ledgers_against_replay(spark, cfg, seed, hot_rows):
    cfg = cfg.with_(hot_group_rows=hot_rows, slice_seconds=1800)
    events = make_ledger(seed)
    want, locked, leases = replay(events)
    f = frames(spark, events)
    states = ledgers.lease_states(f["grants"], f["attempts"], f["revokes"], f["bulk"], cfg)
    assert {r.attempt_id: r.outcome for r in ledgers.redeem_outcomes(f["attempts"], states).collect()} == want["redeem"]
    assert {r.revoke_id: r.effective for r in ledgers.revoke_outcomes(f["revokes"], states).collect()} == want["revoke"]
    assert {(r.bulk_id, r.lease_id) for r in ledgers.bulk_revoked_leases(states).collect()} == want["bulk"]
    outcomes = ledgers.resume_outcomes(f["quarantines"], f["requests"], cfg)
    assert {r.request_id: r.outcome for r in outcomes.collect()} == want["resume"]
    book = ledgers.quarantine_ledger(f["quarantines"], outcomes)
    assert {r.user_id for r in ledgers.active_quarantines(book).collect()} == locked
    end = events[-1]["at"]
    live = {k for k, v in leases.items() if v["status"] == "live" and end <= v["expires"]}
    assert {r.lease_id for r in ledgers.live_leases(states, F.lit(end).cast("timestamp_ntz")).collect()} == live


def test_revoke_after_expiry_still_counts(spark, cfg):
    hour = dt.timedelta(hours=1)
    events = [{"id": 1, "user": 1, "at": T0, "kind": "grant", "lease": None, "expires": T0 + hour},
              {"id": 2, "user": 1, "at": T0 + 2 * hour, "kind": "bulk", "lease": None},
              {"id": 3, "user": 1, "at": T0 + 3 * hour, "kind": "revoke", "lease": 1},
              {"id": 4, "user": 1, "at": T0 + 4 * hour, "kind": "redeem", "lease": 1}]
    f = frames(spark, events)
    states = ledgers.lease_states(f["grants"], f["attempts"], f["revokes"], f["bulk"], cfg)
    assert ledgers.redeem_outcomes(f["attempts"], states).first().outcome == "revoked"
    assert ledgers.bulk_revoked_leases(states).count() == 0


def test_resume_events_and_default_role(spark, cfg, ent):
    f = frames(spark, make_ledger(4))
    outcomes = ledgers.resume_outcomes(f["quarantines"], f["requests"], cfg)
    nobody = spark.createDataFrame([], "user_id bigint, role string")
    counts = {r.outcome: r["count"] for r in outcomes.groupBy("outcome").count().collect()}
    events = ledgers.resume_events(outcomes, nobody, ent, cfg, ttl_seconds=120)
    assert events.count() == counts["denied_missing_or_self"] + 3 * counts["approved"]
    one = json.loads(events.where("event_type = 'lease_issued'").first().payload)
    assert one["role"] == "Unknown" and one["secret_id"] is None and one["ttl_seconds"] == 120


# ---- lockouts and audit events -------------------------------------------------------------
def make_sessions(seed, users=5, days=40):
    rng = random.Random(seed)
    tiers = ["Low", "Medium", "High", "Critical"]
    rows = [(u, DAY + dt.timedelta(days=d), "r", rng.choice(tiers), 50.0, f"s{d}" if rng.random() < 0.5 else None)
            for u in range(users) for d in range(days) if rng.random() < 0.8]
    asks = [(i, dt.datetime.combine(DAY, dt.time()) + dt.timedelta(hours=rng.choice([24 * rng.randrange(days + 2), rng.randrange(24 * days)])),
             rng.randrange(users + 1), rng.choice(["", "boss", "chief", None, "self"])) for i in range(150)]
    return rows, [(i, at, u, str(u) if a == "self" else a) for i, at, u, a in asks]


@pytest.mark.parametrize("hot_rows", [10**9, 5])
@pytest.mark.parametrize("seed", [1, 2])
def test_lockouts_against_replay(spark, cfg, ent, seed, hot_rows):
    cfg = cfg.with_(hot_group_rows=hot_rows, slice_seconds=86400 * 3)
    rows, asks = make_sessions(seed)
    schema = "user_id bigint, day date, role string, risk_tier string, risk_score double, scenario_id string"
    sessions = spark.createDataFrame(rows, schema).withColumns({c: F.col("risk_score") for c in ("isolation_forest_score", "peer_group_score")})
    requests = spark.createDataFrame(asks, "request_id bigint, at timestamp_ntz, user_id bigint, approver string")
    out = policy.run_policy(sessions, ent, cfg, requests)
    actions = {(r.user_id, r.day): r.action for r in out["decisions"].collect()}
    steps = []
    for user, day, *_ in rows:
        at = dt.datetime.combine(day + dt.timedelta(days=1), dt.time())
        steps.append((at, 0, 0, "session", user, day))
        if actions[user, day] in decisions.QUARANTINED:
            steps.append((at, 1, (day - dt.date(1970, 1, 1)).days, "lock", user, day))
    steps += [(at, 1, i, "ask", user, approver) for i, at, user, approver in asks]
    since, locked, closed = {}, {}, []
    for at, _, ident, kind, user, what in sorted(steps, key=lambda s: s[:3]):
        if kind == "session":
            locked[user, what] = since[user][0] if user in since else None
        elif kind == "lock":
            first, n, _ = since.get(user, (at, 0, None))
            since[user] = (first, n + 1, ident)
        elif user in since and what and what != str(user):
            closed.append((user, since[user][0], at, since[user][1], since[user][2], ident, what))
            del since[user]
    closed += [(user, first, None, n, last, None, None) for user, (first, n, last) in since.items()]
    got = [(r.user_id, r.locked_from, r.locked_until, r.n_quarantines, r.quarantine_id, r.request_id, r.released_by) for r in out["intervals"].collect()]
    assert sorted(got, key=str) == sorted(closed, key=str) and any(c[2] for c in closed) and any(c[3] > 1 for c in closed)
    assert {(r.user_id, r.day): r.locked_since for r in out["decisions"].collect()} == locked
    assert all(r.locked == (r.locked_since is not None) for r in out["decisions"].collect())
    reasons = {(r.user_id, r.quarantine_id): r.reason for r in out["quarantines"].collect()}
    assert reasons == {(u, (d - dt.date(1970, 1, 1)).days): "tier High, challenge failed" if t == "High" else f"tier Critical, scenario {s or 'unnamed'}"
                       for u, d, _, t, _, s in rows if actions[u, d] in decisions.QUARANTINED}


def test_requests_are_read_once(spark, cfg, ent):
    """They may be a selection from a large log: every step reads what was written."""
    rows, asks = make_sessions(3)
    schema = "user_id bigint, day date, role string, risk_tier string, risk_score double, scenario_id string"
    sessions = spark.createDataFrame(rows, schema).withColumns({c: F.col("risk_score") for c in ("isolation_forest_score", "peer_group_score")})
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def noted(approver):
        seen.add(1)
        return approver

    requests = spark.createDataFrame(asks, "request_id bigint, at timestamp_ntz, user_id bigint, approver string")
    out = policy.run_policy(sessions, ent, cfg, requests.withColumn("approver", noted("approver")))
    assert len(out["outcomes"].collect()) == len(asks) == seen.value


def test_a_lockout_revokes_the_lease_of_an_earlier_release(spark, cfg, ent):
    rows = [(1, DAY, "ops", "Critical", 90.0, None), (1, DAY + dt.timedelta(days=1), "ops", "Critical", 91.0, None)]
    sessions = spark.createDataFrame(rows, "user_id bigint, day date, role string, risk_tier string, risk_score double, scenario_id string")
    sessions = sessions.withColumns({c: F.col("risk_score") for c in ("isolation_forest_score", "peer_group_score")})
    late = dt.datetime.combine(DAY + dt.timedelta(days=1), dt.time(23, 58))  # two minutes before the second lockout
    requests = spark.createDataFrame([(7, late, 1, "boss")], "request_id bigint, at timestamp_ntz, user_id bigint, approver string")
    out = policy.run_policy(sessions, ent, cfg, requests)
    lease = hashlib.sha256(b"resume|7").hexdigest()[:16]
    events = out["events"].where(F.col("day") == F.lit(DAY + dt.timedelta(days=1))).orderBy("step_no").collect()
    assert [e.event_type for e in events] == ["session_scored", "leases_revoked_bulk", "session_quarantined"]
    assert [json.loads(e.payload).get("lease_ids", json.loads(e.payload).get("revoked_leases")) for e in events[1:]] == [[lease], [lease]]
    assert out["intervals"].count() == 2 and policy.run_policy(sessions, ent, cfg)["intervals"].first().n_quarantines == 2


def test_ledger_events_against_replay(spark, cfg, ent):
    events = make_ledger(5)
    want, _, _ = replay(events)
    f = frames(spark, events)
    f["attempts"] = spark.createDataFrame([(e["id"], e["at"], e["user"], e["lease"]) for e in events if e["kind"] == "redeem"],
                                          "attempt_id bigint, at timestamp_ntz, user_id bigint, lease_id bigint")
    owner = {e["id"]: e["user"] for e in events if e["kind"] == "grant"}
    states = ledgers.lease_states(f["grants"], f["attempts"], f["revokes"], f["bulk"], cfg)
    directory = spark.createDataFrame([(1, "DBA")], "user_id bigint, role string")
    got = [(r.ord, r.user_id, r.event_type, json.loads(r.payload)) for r in
           ledgers.ledger_events(f["grants"], f["attempts"], f["revokes"], f["bulk"], states, directory, ent).orderBy("at", "ord").collect()]
    made = []
    for e in events:
        k, lease = e["id"], None if e["lease"] is None else str(e["lease"])
        if e["kind"] == "grant":
            made.append((k, e["user"], "lease_issued", {
                "lease_id": str(k), "user": str(e["user"]), "role": "DBA" if e["user"] == 1 else "Unknown", "secret_id": "core-db" if e["user"] == 1 else None,
                "reason": "granted on request", "ttl_seconds": int((e["expires"] - e["at"]).total_seconds()), "expires_at": str(e["expires"])}))
        elif e["kind"] == "redeem" and want["redeem"][k] == "redeemed":
            made.append((k, e["user"], "lease_redeemed", {"lease_id": lease, "secret_id": "core-db" if owner[e["lease"]] == 1 else None, "user": str(e["user"])}))
        elif e["kind"] == "redeem" and want["redeem"][k] != "unknown":
            made.append((k, e["user"], "lease_redeem_denied", {"lease_id": lease, "cause": want["redeem"][k]}))
        elif e["kind"] == "revoke":
            made.append((k, owner[e["lease"]], "lease_revoked", {"lease_id": lease, "reason": "withdrawn" + ", no effect" * (not want["revoke"][k])}))
        elif e["kind"] == "bulk" and any(b == k for b, _ in want["bulk"]):
            made.append((k, e["user"], "leases_revoked_bulk", {
                "user": str(e["user"]), "reason": "all leases withdrawn", "lease_ids": [str(x) for x in sorted(x for b, x in want["bulk"] if b == k)]}))
    assert got == made
    assert {m[2] for m in made} == {"lease_issued", "lease_redeemed", "lease_redeem_denied", "lease_revoked", "leases_revoked_bulk"}
