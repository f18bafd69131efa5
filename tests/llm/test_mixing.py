"""Ranges of slots against one fold over all of them, and the bound against the exact weights."""

import math
import random

import pytest

from dayglass.llm import mixing


def order_of(spark, weights, counts, slots):
    """Sources by slot up to the first dry one, and all (source, block) by slot."""
    rows = [(f"={k:04d}", float(w), n) for k, (w, n) in enumerate(zip(weights, counts))]
    found = mixing.exact_slots(spark.createDataFrame(rows, f"{mixing.KEY} string, _w double, _n long"), 1, 64, slots).collect()
    found.sort(key=lambda r: r.slot)
    assert [r.slot for r in found] == list(range(sum(counts)))
    return [int(r[mixing.KEY][1:]) for r in found if not r._left], [(int(r[mixing.KEY][1:]), r.block) for r in found]


def earliest_due_first(weights, dry):
    """The plain fold."""
    shares = [w / sum(weights) for w in weights]
    had, out = [0] * len(shares), []
    for slot in range(dry):
        due = [(math.ceil(round((n + 1) / w, 9)), j) for j, (n, w) in enumerate(zip(had, shares)) if math.floor(round(n / w, 9)) <= slot]
        j = min(due)[1]
        had[j] += 1
        out.append(j)
    return out


def worst(weights, order):
    had, off = [0] * len(weights), 0.0
    for t, j in enumerate(order, 1):
        had[j] += 1
        off = max(off, max(abs(n - t * w / sum(weights)) for n, w in zip(had, weights)))
    return off


@pytest.mark.parametrize("seed", range(6))
def test_ranges_give_the_order_of_one_fold(spark, seed):
    rng = random.Random(seed)
    weights = [rng.choice([1.0, rng.random() + 0.01, rng.random() ** 4 + 0.001, math.sqrt(rng.randint(1, 99))]) for _ in range(rng.randint(1, 11))]
    counts = [max(1, int(400 * w / sum(weights) * (1 + rng.random()))) for w in weights]
    whole, blocks = order_of(spark, weights, counts, mixing.RANGE)
    assert whole == earliest_due_first(weights, len(whole)) and worst(weights, whole) < 1
    for slots in (5, 64):
        assert order_of(spark, weights, counts, slots) == (whole, blocks)
    for source, n in enumerate(counts):
        assert [b for s, b in blocks if s == source] == list(range(n))


def test_the_bound_holds_over_a_hundred_thousand_slots(spark):
    weights = [1 / 3] + [2 / 57] * 19
    order, _ = order_of(spark, weights, [40_000] + [4_300] * 19, mixing.RANGE)
    assert len(order) > 100_000 and worst(weights, order) < 1


def test_more_than_a_thousand_sources_and_no_weight_at_all(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "string(id % 1300) AS source")
    got = mixing.mix(docs, block_docs=2).collect()
    assert len(got) == 4000 and len({(r.slot, r.place) for r in got}) == 4000
    assert mixing.mix(docs, {"1": 0.0}, other=0.0).count() == 0 and mixing.mix(docs, {}).count() == 0


def test_query_uses_the_exact_weights(spark):
    sf = "/root/testdata/sf0.01"
    rows = mixing.query(spark, sf).collect()
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + 1
    names = sorted(sizes, key=lambda s: "" if s is None else f"={s}")
    weights = [math.sqrt(sizes[s]) for s in names]
    dry = math.floor(round(min(math.ceil(sizes[s] / mixing.BLOCK_DOCS) * sum(weights) / w for s, w in zip(names, weights)), 9))
    source_at = {r.slot: r.source for r in rows}
    assert [names.index(source_at[t]) for t in range(dry)] == earliest_due_first(weights, dry)
