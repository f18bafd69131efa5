import datetime as dt
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from dayglass.operators import features, sessions
from dayglass.sources import events as source, logs
from dayglass.sources.schemas import LOG_SCHEMAS


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def at(n, hour=9, minute=0, second=0):
    return dt.datetime.combine(day(n), dt.time(hour, minute, second))


@pytest.fixture(scope="module")
def tiny(spark):
    """Hand-made logs: an empty web log, a single-event day, NULL fields, a night shift."""
    def frame(name, rows):
        return spark.createDataFrame(rows, LOG_SCHEMAS[name])

    return {
        "logon": frame("logon", [(at(0, 8), "ann", "p1", "Logon"), (at(0, 17, 30), "ann", "p1", "Logoff"),
                                 (at(0, 23), "bob", "p2", "Logon"), (at(1, 1), "bob", "p2", "Logoff")]),
        "device": frame("device", [(at(0, 9), "ann", "p1", "Connect", "usb1"), (at(0, 10), "ann", "p1", "Connect", "usb1")]),
        "file": frame("file", [(at(0, 9), "ann", "p1", "f", "Open", 1.5, False), (at(0, 9, 5), "ann", "p3", "f", "Copy", 2.0, True),
                               (at(0, 9, 6), "ann", "p1", "f", None, 4.0, None)]),
        "http": frame("http", []),
        "email": frame("email", [(at(2, 12), "cat", "p9", "external", None, 1), (at(2, 13), "cat", "p9", "internal", 3.0, 0)]),
    }


@pytest.fixture(scope="module")
def folded(tiny, spark):
    directory = spark.createDataFrame([("ann", "DBA"), ("bob", "SOC")], "user_id string, role string")
    answers = spark.createDataFrame([("ann", day(0), "B"), ("ann", day(0), "A")], "user_id string, day date, scenario_id string")
    rows = sessions.user_day_table(logs.unify_logs(tiny), directory, answers).collect()
    return {(r.user_id, r.day): r for r in rows}


def test_fold_rules(folded):
    assert set(folded) == {("ann", day(0)), ("bob", day(0)), ("bob", day(1)), ("cat", day(2))}
    ann = folded["ann", day(0)]
    assert ann.session_duration_min == 570.0
    assert ann.n_device_connects == 1  # distinct devices, not connects
    assert (ann.n_pcs_used, ann.n_file_events, ann.file_volume_mb, ann.export_volume_mb) == (2, 2, 7.5, 2.0)
    assert (ann.n_http_events, ann.http_export_mb) == (0, 0.0)
    # work past midnight counts for the next day
    assert folded["bob", day(0)].session_duration_min == 0.0 and folded["bob", day(1)].n_events == 1


def test_nulls_and_lookups(folded):
    cat = folded["cat", day(2)]
    assert (cat.n_email_events, cat.email_volume_mb, cat.email_external_count) == (1, 3.0, 1)
    assert cat.role is None  # not in the directory
    assert not cat.is_malicious and cat.scenario_id is None
    assert folded["ann", day(0)].is_malicious and folded["ann", day(0)].scenario_id == "A"  # duplicates count once


def test_single_pass_equals_five_logs(inputs):
    union = logs.unify_logs(source.logs(inputs.events))
    one = inputs.activity.select(*union.columns)
    assert union.exceptAll(one).count() == 0 and one.exceptAll(union).count() == 0


def entropy(values):
    n = len(values)
    return sum(-c / n * math.log2(c / n) for c in Counter(values).values())


@pytest.fixture(scope="module")
def random_days(spark):
    """Random hours, hosts and gaps per user for the loop twins."""
    rng = random.Random(11)
    data = []
    for user in range(12):
        for d in range(45):
            if rng.random() < 0.6:
                for _ in range(rng.randrange(1, 6)):
                    data.append((user, at(d, rng.randrange(24), rng.randrange(60), rng.randrange(60)), f"p{rng.randrange(6)}",
                                 f"u{rng.randrange(9)}" if rng.random() < 0.3 else None))
    logon = spark.createDataFrame([(t, str(u), p, "Logon") for u, t, p, _ in data], LOG_SCHEMAS["logon"])
    device = spark.createDataFrame([(t, str(u), p, "Connect", d) for u, t, p, d in data if d], LOG_SCHEMAS["device"])
    return data, logs.unify_logs({"logon": logon, "device": device})


def test_activity_folds_in_one_shuffle_as_its_cells_do(tiny, random_days):
    for activity in (logs.unify_logs(tiny), random_days[1]):
        direct, by_cells = (f.orderBy("user_id", "day") for f in (
            sessions.fold_activity(activity), sessions.fold_cells(sessions.activity_cells(activity))))
        assert direct.columns == by_cells.columns and direct.collect() == by_cells.collect()
        text = sessions.fold_activity(activity)._jdf.queryExecution().executedPlan().toString()
        assert text.count("Exchange") == 1 and "partial_" in text


def test_first_seen_needs_no_cells(random_days, cfg):
    activity, spine = random_days[1], sessions.user_day_spine(random_days[1])
    direct, by_cells = (features.new_item_days(x, spine, cfg).orderBy("user_id", "day").collect()
                        for x in (activity, sessions.activity_cells(activity)))
    assert direct == by_cells and direct


def test_number_k_is_what_the_json_parser_says(spark):
    plain = ['{"k": 0}', '{"k":7}', '{"k": 123456789}']
    other = ['{"k": 007}', '{"k": -3}', '{"k": 1.5}', '{"k": 1e3}', '{"k":  8}', '{"k": 12345678901}', '{"k": "9"}', '{"k": null}', '{"j": 1, "k": 2}',
             '{"k": 4}\n', ' {"k": 5}', '{"k": 1, "k": 2}', '{"k": {"k": 3}}', '{"k": }', '{"k": 6', '{"K": 6}', "[]", "", None]
    df = spark.createDataFrame([(x,) for x in plain + other], "p string")
    rows = df.select("p", source.number_k("p").alias("got"), F.get_json_object("p", "$.k").alias("want"), F.col("p").rlike(source.ONLY_K).alias("plain")).collect()
    assert [r.got for r in rows] == [r.want for r in rows]
    assert [r.p for r in rows if r.plain] == plain


def per_user(data):
    users = {}
    for u, t, p, d in data:
        users.setdefault(str(u), {}).setdefault(t.date(), []).append((t, p, d))
    return users


def test_rolling_entropies_loop(random_days, cfg):
    data, activity = random_days
    days = sessions.fold_cells(sessions.activity_cells(activity))
    got = {(r.user_id, r.day): (r.hour_entropy_7d, r.dow_entropy_30d)
           for r in features.rolling_entropies(days, cfg).collect()}
    for u, byday in per_user(data).items():
        for d in byday:
            hours = [t.hour for e, rows in byday.items() if 0 <= (d - e).days < 7 for t, _, dev in rows for _ in range(2 if dev else 1)]
            dows = [e.weekday() for e in byday if 0 <= (d - e).days < 30]
            assert got[u, d] == pytest.approx((entropy(hours), entropy(dows)), abs=1e-9)
            assert got[u, d][0] <= math.log2(24) and got[u, d][1] <= math.log2(7)


def test_first_seen_loop(random_days, cfg):
    data, activity = random_days
    got = {(r.user_id, r.day): (r.new_host_flag, r.new_device_flag)
           for r in features.new_item_days(sessions.activity_cells(activity), sessions.user_day_spine(activity), cfg).collect()}
    for u, byday in per_user(data).items():
        hosts, devices, start = set(), set(), min(byday)
        for d in sorted(byday):
            today_hosts, today_devices = {p for _, p, _ in byday[d]}, {x for *_, x in byday[d] if x}
            flags = (int(bool(today_hosts - hosts)), int(bool(today_devices - devices))) if (d - start).days >= cfg.warmup_days else (0, 0)
            assert got.get((u, d), (0, 0)) == flags
            hosts |= today_hosts
            devices |= today_devices


def test_bigram_probabilities_sum_to_one(inputs, cfg):
    counts = features.bigram_counts(features.session_bigrams(inputs.activity, cfg), cfg)
    total = counts.groupBy("kind").agg(F.sum("count").alias("t"))
    parts = counts.join(total, "kind").groupBy("kind").agg(F.sum(F.col("count") / F.col("t")).alias("p")).collect()
    assert parts and all(r.p == pytest.approx(1.0) for r in parts)


def test_unseen_pairs_under_frozen_counts(spark):
    pairs = spark.createDataFrame([("a", day(0), "url", "x", "y", 1)], "user_id string, day date, kind string, a string, b string, n bigint")
    counts = spark.createDataFrame([("url", "p", "q", 7)], "kind string, a string, b string, count bigint")
    assert features.bigram_rarity(pairs, counts).first().url_bigram_rarity == pytest.approx(3.0)
    empty = counts.where("false")
    assert features.bigram_rarity(pairs, empty).first().url_bigram_rarity == pytest.approx(0.0)


def test_entropy_edges(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b"), (3, None)], "g int, x string")
    got = {r.g: r.entropy for r in features.entropy_of(rows, ["g"], "x").collect()}
    assert got == {1: 0.0, 2: 1.0}
