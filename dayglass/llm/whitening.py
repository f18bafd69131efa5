"""Whitening of embeddings by pivoted Cholesky and one-sided Jacobi.

Entries are scaled to integers, floor(256 c). The model is fitted on every distinct vector once.
Sums and the scatter matrix are sums of integers, so they are exact and do not depend on the order
of tasks: vectors are centred by the rounded mean, multiplied, and the centring is completed by
the rest of the mean, in integers still. Only matrices of the vectors' dimension reach the driver.

There the scatter matrix is factored by Cholesky with diagonal pivots, and the columns of that
triangular factor are rotated in pairs until all are orthogonal. Their squared norms are the
eigenvalues and the normalised columns the components; no matrix is multiplied out on the way, so
small eigenvalues keep their digits.

Defined results: rows with a null vector or a null or non-finite entry are left out, as are
vectors of another length than the commonest among the distinct ones (of equally common ones the
shortest, empty ones never count) and those with a scaled entry of 2^31 or more; repeated rows
are fitted once and each returned; directions without variance, up to rounding, have no
component, so vectors that are all alike have none at all; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import materialize
from .common import map_columns, table, with_columns

SCALE, COMPONENTS = 256, 4
LARGEST = 1 << 31
SLICE_ROWS = 4096  # vectors that are multiplied at a time
EXACT = 1 << 53  # integers below it are exact as doubles
SWEEPS = 60
VECTOR = "_x"


def quantized(rows: DataFrame, column: str = "embedding", scale: int = SCALE, largest: int = LARGEST) -> DataFrame:
    """The rows with a usable vector, with it as whole numbers in `_x`."""
    def usable(c: Column) -> Column:
        return F.coalesce(~F.isnan(c) & (F.abs(c) < largest / scale), F.lit(False))

    vector = F.col(column).cast("array<double>")
    rows = rows.where(vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, usable))
    return rows.withColumn(VECTOR, F.transform(vector, lambda c: F.floor(c * scale)))


@dataclass
class Whitening:
    n: int  # distinct vectors
    sums: np.ndarray  # by dimension, Python integers
    eigenvalues: np.ndarray  # of the covariance, falling
    components: np.ndarray  # a column for each eigenvalue
    trace: float
    largest: int  # greatest entry by size

    @property
    def mean(self) -> np.ndarray:
        return np.array([float(s) / self.n for s in self.sums])


def matrix(batch: pa.RecordBatch, column: str = VECTOR) -> np.ndarray:
    """The vectors of a batch as rows of integers."""
    return batch[column].flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, -1)


def totals(parts: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """Sums by index of rows (i, value), as Python integers."""
    out = np.zeros(int(np.prod(shape)), object)
    for row in parts.groupBy("i").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("s")).collect():  # one for each entry of the matrix
        out[row.i] = int(row.s)
    return out.reshape(shape)


def integer_sums(fit_list: DataFrame, of_batch, entries: int) -> DataFrame:
    """Rows (i, value): the entries of `of_batch` summed over each partition. A sum that would
    leave 64 bits is returned early and begun anew."""
    def work(batches):
        held, room = None, 0
        for batch in (b.slice(at, SLICE_ROWS) for b in batches for at in range(0, b.num_rows, SLICE_ROWS)):
            values, bound = of_batch(batch)
            if held is not None and room + bound >= 1 << 62:
                yield [np.arange(entries), held]
                held = None
            held, room = (values, bound) if held is None else (held + values, room + bound)
        if held is not None:
            yield [np.arange(entries), held]

    return map_columns(fit_list, "i long, value long", work)


def scatter(fit_list: DataFrame, n: int, sums: np.ndarray) -> np.ndarray:
    """n times the centred scatter matrix, in Python integers."""
    d = len(sums)
    middle = np.array([(2 * int(s) + n) // (2 * n) for s in sums], np.int64)  # the mean, rounded

    def products(batch: pa.RecordBatch) -> tuple[np.ndarray, int]:
        z = matrix(batch) - middle
        bound = int(np.abs(z).max()) ** 2 * len(z)
        if bound < EXACT:  # every partial sum is exact in doubles, which multiply faster
            return (z.astype(np.float64).T @ z.astype(np.float64)).astype(np.int64).ravel(), bound
        return (z.T @ z).ravel(), bound

    def halves(batch: pa.RecordBatch) -> tuple[np.ndarray, int]:  # sums of such products leave 64 bits: keep high and low bits apart
        z = (matrix(batch) - middle).astype(object)
        every = (z.T @ z).ravel()
        return np.concatenate([np.array([int(v) >> 40 for v in every], np.int64), np.array([int(v) & ((1 << 40) - 1) for v in every], np.int64)]), 1 << 54

    largest = fit_list.agg(F.max(F.array_max(F.transform(VECTOR, lambda c: F.abs(c)))).alias("m")).first().m
    if (2 * int(largest)) ** 2 < 1 << 48:
        products_sum = totals(integer_sums(fit_list, products, d * d), (d, d))
    else:
        high, low = totals(integer_sums(fit_list, halves, 2 * d * d), (2, d, d))
        products_sum = high * (1 << 40) + low
    rest = np.array([int(s) - n * int(m) for s, m in zip(sums, middle)], object)
    return n * products_sum - np.outer(rest, rest)


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """G with a = G G^T: the lower triangular factor by falling diagonal pivots, its rows put back
    in the order of `a`, and as many columns as `a` has rank up to rounding."""
    rest, d = a.copy(), len(a)
    out, least = np.zeros((d, d)), d * np.finfo(float).eps * max(float(a.diagonal().max(initial=0.0)), 0.0)
    for k in range(d):
        pivot = int(np.argmax(rest.diagonal()))
        value = rest[pivot, pivot]
        if value <= least:
            return out[:, :k]
        out[:, k] = rest[:, pivot] / np.sqrt(value)
        rest -= np.outer(out[:, k], out[:, k])
        rest[pivot, :] = rest[:, pivot] = 0.0
    return out


def rounds(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """All pairs below n in rounds of disjoint ones (a round-robin tournament)."""
    seats = list(range(n + n % 2))
    out = []
    for _ in range(len(seats) - 1):
        pairs = [(min(a, b), max(a, b)) for a, b in zip(seats[:len(seats) // 2], reversed(seats)) if max(a, b) < n]
        if pairs:
            out.append(tuple(np.array(x) for x in zip(*pairs)))
        seats = [seats[0], seats[-1], *seats[1:-1]]
    return out


def jacobi(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared norms and normalised columns, by falling norm, of `factor` after rotating its
    columns until all pairs are orthogonal to double precision."""
    g, tolerance = factor.copy(), np.finfo(float).eps
    plan = rounds(g.shape[1])
    for _ in range(SWEEPS):
        rotated = False
        for left, right in plan:  # the pairs of a round are disjoint, so they turn at once
            x, y = g[:, left], g[:, right]
            alpha, beta, gamma = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            turn = np.abs(gamma) > tolerance * np.sqrt(alpha * beta)
            if not turn.any():
                continue
            rotated = True
            x, y, zeta = x[:, turn], y[:, turn], (beta - alpha)[turn] / (2 * gamma[turn])
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1 / np.hypot(1.0, t)
            g[:, left[turn]], g[:, right[turn]] = c * x - c * t * y, c * t * x + c * y
        if not rotated:
            break
    norms = (g * g).sum(0)
    order = np.argsort(-norms, kind="stable")
    return norms[order], g[:, order] / np.sqrt(norms[order])


def fit(vectors: DataFrame) -> tuple[Whitening | None, DataFrame]:
    """The model of quantized vectors (None without any), and the fit list: each distinct vector once."""
    fit_list = materialize(vectors.select(VECTOR).distinct(), "whitening-fit")
    sizes = fit_list.groupBy(F.size(VECTOR).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if sizes is None:
        return None, fit_list
    d, n = sizes.d, sizes.n
    fit_list = fit_list.where(F.size(VECTOR) == d)

    def column_sums(batch: pa.RecordBatch) -> tuple[np.ndarray, int]:
        return matrix(batch).sum(0), LARGEST * batch.num_rows

    sums = totals(integer_sums(fit_list, column_sums, d), (d,))
    covariance = np.array([[int(v) / (n * n) for v in row] for row in scatter(fit_list, n, sums)])
    eigenvalues, components = jacobi(pivoted_cholesky(covariance))
    largest = int(fit_list.agg(F.max(F.array_max(F.transform(VECTOR, lambda c: F.abs(c))))).first()[0])
    return Whitening(n, sums, eigenvalues, components, float(np.trace(covariance)), largest), fit_list


def project(model: Whitening, x: np.ndarray, components: int) -> np.ndarray:
    """The first whitened components of the rows of x."""
    centred = x - model.mean
    return centred @ (model.components[:, :components] / np.sqrt(model.eigenvalues[:components]))


def whiten(vectors: DataFrame, model: Whitening, components: int = COMPONENTS) -> DataFrame:
    """`vectors` of the model's length with whitened (their first components, as many as there
    are) and deviation, the sum over dimensions of (n x - S)^2, which is exact."""
    d = len(model.sums)
    shared = vectors.sparkSession.sparkContext.broadcast(model)  # of the size of a matrix of the dimension
    small = d * (2 * model.n * model.largest) ** 2 < 1 << 62
    kind = np.int64 if small else object

    def work(batch: pa.RecordBatch) -> list:
        m = shared.value
        x = matrix(batch) if batch.num_rows else np.empty((0, d), np.int64)
        if kind is object:
            away = [str(sum(int(v) ** 2 for v in row)) for row in m.n * x.astype(object) - m.sums]
        else:
            away = list(map(str, ((m.n * x - m.sums.astype(np.int64)) ** 2).sum(1).tolist()))
        return [project(m, x, components).tolist(), away]

    rows = with_columns(vectors.where(F.size(VECTOR) == d), "whitened array<double>, deviation string", work)
    return rows.withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))


def identity_error(fit_list: DataFrame, model: Whitening, components: int = COMPONENTS) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""
    shared, k = fit_list.sparkSession.sparkContext.broadcast(model), min(components, len(model.eigenvalues))

    def work(batches):
        sums, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                w = project(shared.value, matrix(batch), k)
                sums, products = sums + w.sum(0), products + w.T @ w
        yield [np.arange(k * (k + 1)), np.concatenate([sums, products.ravel()])]

    if not k:
        return 0.0
    rows = map_columns(fit_list, "i int, value double", work).groupBy("i").agg(F.sum("value").alias("s")).orderBy("i").collect()
    values = np.array([r.s for r in rows]) / model.n
    mean, products = values[:k], values[k:].reshape(k, k)  # the vectors were centred, so this mean is rounding alone
    return float(np.abs(products - np.outer(mean, mean) - np.eye(k)).max())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantized(table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")).select("vec_id", VECTOR)
    model, fit_list = fit(vectors)
    if model is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    share = [float(e / model.trace) for e in model.eigenvalues[:COMPONENTS]]
    rows = whiten(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("_at", "whitened"))
    return rows.select("vec_id", (F.col("_at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), F.col("deviation").cast("long").alias("deviation"),
                       "whitened", F.get(F.array(*map(F.lit, share)).cast("array<double>"), F.col("_at")).alias("explained"),
                       F.lit(identity_error(fit_list, model)).alias("identity_error"))
