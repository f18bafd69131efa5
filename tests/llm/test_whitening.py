"""Whitening against a dense eigensolver and exact integers."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from dayglass.llm import whitening

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>"


def frame(spark, vectors, first=0):
    return spark.createDataFrame([(first + k, None if v is None else [None if c is None else float(c) for c in v]) for k, v in enumerate(vectors)], SCHEMA)


def model_of(spark, vectors):
    return whitening.fit(whitening.quantized(frame(spark, vectors)))


def expected(x):
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    centred = fit - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return n, sums, values[::-1], vectors[:, ::-1]


def test_query_equals_a_dense_solver(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x = np.array([np.floor(256 * np.array(r.embedding, float)) for r in table]).astype(np.int64)
    n, sums, values, vectors = expected(x)
    want = (x - sums / n) @ vectors[:, :4] / np.sqrt(values[:4])
    rows = {(r.vec_id, r.component): r for r in whitening.query(spark, SF).collect()}
    assert len(rows) == 4 * len(table)
    for k in range(4):
        got = np.array([rows[r.vec_id, k + 1].whitened for r in table])
        assert np.abs(got * np.sign(got @ want[:, k]) - want[:, k]).max() < 1e-9
        assert abs(rows[0, k + 1].explained - values[k] / values.sum()) < 1e-12
    assert all(rows[r.vec_id, 1].deviation == d for r, d in zip(table, ((n * x - sums) ** 2).sum(1).tolist()))
    assert rows[0, 1].n == n and rows[0, 1].identity_error < 1e-10


def test_factor_and_rotation_reach_small_eigenvalues():
    rng = np.random.default_rng(4)
    basis = np.linalg.qr(rng.normal(size=(9, 9)))[0]
    for values in (10.0 ** -np.arange(9), np.array([5, 5, 5, 1, 1, 1, 0, 0, 0]), np.zeros(9), np.ones(9)):
        a = (basis * values) @ basis.T
        factor = whitening.pivoted_cholesky((a + a.T) / 2)
        found, components = whitening.jacobi(factor)
        assert np.allclose(factor @ factor.T, a, atol=1e-14) and factor.shape[1] == (values > 0).sum()
        assert np.allclose(found, values[values > 0], rtol=1e-6) and (np.diff(found) <= 1e-12).all()
        assert np.allclose(components.T @ components, np.eye(len(found)), atol=1e-13)
        assert np.allclose(a @ components, components * found, atol=1e-13)


def test_rounds_hold_each_pair_once_and_disjointly():
    for n in range(1, 12):
        plan = [list(zip(a.tolist(), b.tolist())) for a, b in whitening.rounds(n)]
        assert sorted(sum(plan, [])) == [(a, b) for a in range(n) for b in range(a + 1, n)]
        assert all(len({x for pair in pairs for x in pair}) == 2 * len(pairs) for pairs in plan)


@pytest.mark.parametrize("far", [0, 1000, 8_000_000])
def test_scatter_and_deviation_are_exact_however_far_the_mean(spark, far):
    rng = np.random.default_rng(2)
    x = np.array([[far + c / 4 for c in v] for v in rng.integers(-9, 9, (300, 3))])
    x = np.concatenate([x, x[:50]])  # repeated rows are fitted once
    vectors = whitening.quantized(frame(spark, x).withColumn("embedding", F.col("embedding").cast("array<double>")))
    model, fit_list = whitening.fit(vectors)
    whole = np.floor(256 * np.float32(x).astype(float)).astype(np.int64)
    fit = np.unique(whole, axis=0).astype(object)
    n, sums = len(fit), fit.sum(0)
    assert model.n == n and list(model.sums) == list(sums)
    exact = [[sum(Fraction(n * v[i] - sums[i]) * (n * v[j] - sums[j]) for v in fit) / n ** 2 * n for j in range(3)] for i in range(3)]
    assert whitening.scatter(fit_list, n, model.sums).tolist() == exact
    rows = whitening.whiten(vectors, model).collect()
    assert len(rows) == len(x)
    assert all(int(r.deviation) == sum((n * a - s) ** 2 for a, s in zip(r["_x"], sums)) for r in rows)
    assert whitening.identity_error(fit_list, model) < 1e-6


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    good = rng.normal(size=(40, 3))
    odd = [None, [None, 1, 2], [float("nan"), 0, 0], [float("inf"), 0, 0], [1, 2], [], [1e30, 0, 0], good[0], good[0]]
    docs = frame(spark, [*good, *odd]).unionByName(spark.createDataFrame([(None, [0.0, 0.5, 1.0])], SCHEMA))
    docs = docs.withColumns({c: F.lit("x") for c in ("whitened", "deviation", "component", "n")})
    vectors = whitening.quantized(docs)
    model, _ = whitening.fit(vectors)
    rows = whitening.whiten(vectors, model).collect()
    assert model.n == 41 and sorted(r.vec_id for r in rows if r.vec_id is not None) == [*range(40), 47, 48] and len(rows) == 43
    assert len({tuple(r.whitened) for r in rows if r.vec_id in (0, 47, 48)}) == 1 and all(r.component == "x" for r in rows)


def test_tables_without_variance(spark, tmp_path):
    alike, fit_list = model_of(spark, [[1, 2, 3]] * 5)
    assert alike.n == 1 and len(alike.eigenvalues) == 0 and whitening.identity_error(fit_list, alike) == 0
    line, fit_list = model_of(spark, [[k, 2 * k, 7] for k in range(9)])
    assert len(line.eigenvalues) == 1 and whitening.identity_error(fit_list, line) < 1e-12
    assert model_of(spark, [])[0] is None
    for name, vectors, n in (("alike", [[1, 2, 3]] * 5, 0), ("line", [[k, 2 * k, 7] for k in range(9)], 9), ("none", [], 0), ("bad", [None, [None]], 0)):
        frame(spark, vectors).write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        found = whitening.query(spark, f"{tmp_path}/{name}")
        assert found.count() == n and found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
