"""Hard negatives against a plain loop over all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dayglass.llm import hard_negatives as mining

SCHEMA = "id long, label int, embedding array<float>"


def test_strassen_equals_the_product_of_any_shape():
    rng = np.random.default_rng(1)
    for _ in range(300):
        m, k, n = rng.integers(0, 40, 3)
        a, b = (rng.integers(-2 ** 62, 2 ** 62, shape) for shape in ((m, k), (k, n)))
        with np.errstate(over="ignore"):
            assert (mining.strassen(a, b, leaf=int(rng.integers(1, 9))) == a @ b).all()
    a, b = rng.integers(-2 ** 24, 2 ** 24, (70, 65)), rng.integers(-2 ** 24, 2 ** 24, (65, 67))
    assert (mining.strassen(a, b) == a.astype(object) @ b.astype(object)).all()


def test_heaps_merge_to_the_best_of_all():
    rng = np.random.default_rng(2)
    for _ in range(200):
        owners, n = 3, int(rng.integers(1, 40))
        scores, allowed = rng.integers(-3, 4, (owners, n)), rng.random((owners, n)) < 0.6
        ids = np.sort(rng.integers(0, 9, n))
        places = np.arange(n)
        parts = [mining.Heaps(owners, 4) for _ in range(3)]
        for part, at in zip(parts, np.array_split(np.arange(n), 3)):
            if len(at):
                part.push(np.arange(owners), scores[:, at], allowed[:, at], ids[at], places[at])
        for other in parts[1:]:
            parts[0].merge(other.entries)
        for k in range(owners):
            want = sorted((-scores[k, j], ids[j], j) for j in range(n) if allowed[k, j])[:4]
            assert [(-s, i, p) for s, i, p in parts[0].entries[k] if s != mining.NONE] == want


def brute(rows, every):
    """Result rows of usable (id, label, whole vector), each row of its own."""
    out = []
    key = lambda j: (rows[j][0] is None, rows[j][0] or 0, j)
    for i, (anchor, label, x) in enumerate(rows):
        if anchor is None or anchor % every:
            continue
        score = [sum(a * b for a, b in zip(x, y)) for _, _, y in rows]
        order = sorted((j for j in range(len(rows)) if j != i), key=lambda j: (-score[j], key(j)))
        for p in [j for j in order if rows[j][1] == label][:5]:
            fits = [j for j in order if rows[j][1] != label and 80 * score[p] <= 100 * score[j] <= 100 * score[p]]
            out += [(anchor, rows[p][0], k + 1, rows[j][0], score[p], score[j]) for k, j in enumerate(fits[:5])]
    return out


def sort_key(row):
    return tuple((v is None, v or 0) for v in row)


def found(spark, rows, **sizes):
    frame = spark.createDataFrame([(i, label, None if x is None else [None if c is None else float(c) for c in x]) for i, label, x in rows], SCHEMA)
    return sorted(map(tuple, mining.hard_negatives(frame, **sizes).collect()), key=sort_key)


@pytest.mark.parametrize("block_rows, anchor_rows, group_blocks", [(7, 3, 2), (2048, 512, 4)])
def test_blocks_of_any_size_equal_brute_force(spark, block_rows, anchor_rows, group_blocks):
    rng = np.random.default_rng(3)
    base = rng.normal(0.3, 0.4, (160, 5)).astype(np.float32)
    base[60:110] = base[60]  # a third of the rows is one vector: ties by id
    rows = [(k, int(rng.integers(0, 3)), x.tolist()) for k, x in enumerate(base)]
    rows += [(None, 1, base[1].tolist()), (10, 2, base[10].tolist()), (20, 0, base[3].tolist())]
    whole = [(i, label, [int(np.floor(256 * float(np.float32(c)))) for c in x]) for i, label, x in rows]
    assert found(spark, rows, every=10, block_rows=block_rows, anchor_rows=anchor_rows, group_blocks=group_blocks) == sorted(brute(whole, 10), key=sort_key)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = []
    for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect():
        if r.label is not None and r.embedding is not None and all(c is not None and np.isfinite(c) for c in r.embedding):
            rows.append((r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, [int(np.floor(256 * c)) for c in r.embedding]))
    assert sorted(map(tuple, mining.query(spark, sf).collect())) == sorted(brute(rows, 100))


def test_odd_rows(spark):
    rng = np.random.default_rng(4)
    good = [(k, k % 2, rng.normal(0.5, 0.2, 3).astype(np.float32).tolist()) for k in range(30)]
    odd = [(100, None, [1, 1, 1]), (200, 1, None), (300, 1, [None, 1, 1]), (400, 0, [float("nan"), 1, 1]), (500, 0, [float("inf"), 1, 1]), (600, 1, [1, 1]),
           (700, 0, []), (800, 0, [1e30, 1, 1])]
    whole = [(i, label, [int(np.floor(256 * c)) for c in x]) for i, label, x in good]
    assert found(spark, good + odd, every=10) == sorted(brute(whole, 10), key=sort_key)
    large = [(k, k % 2, [60000.0 - k, 3.0 * k, -5.0]) for k in range(12)]
    assert found(spark, large, every=5) == sorted(brute([(i, l, [int(256 * c) for c in x]) for i, l, x in large], 5), key=sort_key)
    opposed = [(0, 0, [1, 0]), (1, 0, [-1, 0]), (2, 1, [-1, 0]), (3, 1, [0, 1])]  # the only positive scores below 0
    assert found(spark, opposed) == []
    assert found(spark, [(0, 0, [1, 0]), (1, 0, [0, 1]), (2, 1, [0, 1]), (3, 1, [0, -1])]) == [(0, 1, 1, 2, 0, 0), (0, 1, 2, 3, 0, 0)]
    assert found(spark, [(0, 0, [1, 0]), (1, 1, [1, 0])]) == []  # no positive


def test_empty_tables_and_extra_columns(spark):
    assert found(spark, []) == [] and found(spark, odd_only()) == []
    assert found(spark, [(k, 0, [1.0]) for k in range(1, 9)]) == []  # no anchor
    rows = spark.createDataFrame([(k, k % 2, [1.0, k / 8]) for k in range(9)], SCHEMA)
    plain = sorted(map(tuple, mining.hard_negatives(rows).collect()))
    clash = rows.withColumns({c: F.lit("x") for c in ("a", "block", "group", "ids", "labels", "vectors", "places", "_x")})
    assert sorted(map(tuple, mining.hard_negatives(clash).collect())) == plain and plain


def odd_only():
    return [(0, None, [1.0]), (100, 1, None), (200, 1, [])]
