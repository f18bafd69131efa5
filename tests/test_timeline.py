"""Sliced and plain ordered operators give the same rows, also when one key is hot."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from dayglass.operators import features, timeline

SCHEMA = "user_id bigint, ts timestamp_ntz, id bigint, v string, marked boolean"


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    data = []
    for i in range(3000):
        user = 7 if i % 3 == 0 else rng.randrange(40)
        # many equal instants, so that ties are decided by id
        data.append((user, start + dt.timedelta(seconds=rng.randrange(0, 40000, 40)), i, rng.choice("abcd"), rng.random() < 0.2))
    return spark.createDataFrame(data, SCHEMA)


def loop(rows, pick):
    """Plain Python twin over the rows of each user in order."""
    out = {}
    groups = {}
    for r in rows.collect():
        groups.setdefault(r.user_id, []).append(r)
    for group in groups.values():
        group.sort(key=lambda r: (r.ts, r.id))
        for i, r in enumerate(group):
            out[r.id] = pick(group, i)
    return out


def first(items):
    return next(iter(items), None)


CASES = {
    "next": (lambda df, c: timeline.next_in_order(df, ["user_id"], "ts", "id", F.col("v"), "out", c),
             lambda g, i: g[i + 1].v if i + 1 < len(g) else None),
    "last_seen": (lambda df, c: timeline.last_seen(df, ["user_id"], "ts", "id", F.when(F.col("marked"), F.col("id")), "out", c),
                  lambda g, i: first(r.id for r in reversed(g[:i + 1]) if r.marked)),
    "next_seen": (lambda df, c: timeline.next_seen(df, ["user_id"], "ts", "id", F.when(F.col("marked"), F.col("id")), "out", c),
                  lambda g, i: first(r.id for r in g[i:] if r.marked)),
    "position": (lambda df, c: timeline.position(df, ["user_id"], "ts", "id", "out", c), lambda g, i: i + 1),
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("hot_rows", [10**9, 10])
def test_against_loop(rows, cfg, case, hot_rows):
    spark_form, pick = CASES[case]
    got = {r.id: r.out for r in spark_form(rows, cfg.with_(hot_group_rows=hot_rows, slice_seconds=300)).collect()}
    assert got == loop(rows, pick)


def test_hot_and_plain_bigrams_agree(inputs, cfg):
    plain = features.session_bigrams(inputs.activity, cfg, largest=1)
    hot = features.session_bigrams(inputs.activity, cfg.with_(hot_group_rows=0), largest=1)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, hot.collect()))


def test_size_is_looked_at(rows, cfg):
    assert timeline.largest_group(rows, ["user_id"]) > 1000
    assert timeline.is_hot(rows, ["user_id"], cfg.with_(hot_group_rows=1000))
    assert not timeline.is_hot(rows, ["user_id"], cfg)
