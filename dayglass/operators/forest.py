"""Isolation forest (Liu, Ting and Zhou, ICDM 2008) as Spark jobs, drawn by hash.

Nothing is random: which rows a tree sees, which feature a node splits and where are read off
SHA-256 of the row's key or of (seed, tree, node). So the same rows give the same forest under any
partitioning and in any engine, and plain SQL can grow and descend the same trees.

Fitting needs only `n_trees` small samples. Each row enters each tree with probability p; whether it
enters any, and the first one it enters, follow from one hash, so the table is read once, all but
about `2 x n_trees x tree_rows` rows are dropped after that one hash, and the same rule holds for
tables of every size.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import EngineConfig

NODE_SCHEMA = "tree_id int, node_id int, feature int, threshold double, rows int, depth int"
GRID = 1e6      # values are compared in millionths, so that rounding errors split nothing
DIGITS = 12     # hex digits of a hash that make a number
PER_HASH = 5    # such numbers in one hash


def depth_limit(cfg: EngineConfig, rows: int) -> int:
    return math.ceil(math.log2(max(rows, 2)))


def mean_path(n):
    """Expected path length of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 3.0)
    harmonic = np.log(big - 1.0) + np.euler_gamma
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, 2.0 * harmonic - 2.0 * (big - 1.0) / big))


# ---- sampling ----------------------------------------------------------------------------
def on_grid(value: Column) -> Column:
    return F.rint(value * F.lit(GRID))


def _unit(digest: Column, place: Column) -> Column:
    """The number in [0, 1) that `DIGITS` hex digits spell, the first of them at `place`."""
    return F.conv(F.substr(digest, place, F.lit(DIGITS)), 16, 10).cast("bigint") / F.lit(float(16**DIGITS))


def draw_chance(n_rows: int, take: int) -> float:
    """Probability that a row enters a tree: twice the sample and some, so that none falls short."""
    return min(1.0, (2 * take + 20) / n_rows)


def tree_samples(df: DataFrame, columns: Sequence[str], key: Sequence[str], n_rows: int,
                 cfg: EngineConfig) -> DataFrame:
    """(tree_id, place, columns): `tree_rows` rows without repetition for every tree.

    A row's first hash u decides its first tree: the first t with u < 1-(1-p)^(t+1), if any. It
    enters each later tree if its own number for that tree is below p. Of a tree's rows those
    with the least numbers are its sample.
    """
    take = min(cfg.tree_rows, n_rows)
    chance = draw_chance(max(n_rows, 1), take)
    upto = [1.0 - (1.0 - chance) ** (t + 1) for t in range(cfg.n_trees)]
    name = F.concat_ws("|", F.lit(str(cfg.seed)), *[F.col(k).cast("string") for k in key])
    rows = df.select(*key, *columns, name.alias("_name"))
    rows = rows.withColumn("_u", _unit(F.sha2("_name", 256), F.lit(1))).where(F.col("_u") < upto[-1])
    # one hash serves a block of trees; pairs of row and tree are compared one by one, as plain rows
    trees = [F.struct(F.lit(t).alias("tree_id"), F.lit(low).alias("low"), F.lit(high).alias("high"))
             for t, (low, high) in enumerate(zip([0.0, *upto], upto))]
    blocks = F.array(*[F.array(*trees[t:t + PER_HASH]) for t in range(0, len(trees), PER_HASH)])
    rows = rows.select("*", F.posexplode(blocks).alias("_block", "_trees"))
    rows = rows.withColumn("_digest", F.sha2(F.concat_ws("|", "_name", F.col("_block").cast("string")), 256))
    pairs = rows.select(*key, *columns, "_u", "_digest", F.posexplode("_trees").alias("_j", "_tree"))
    place = F.col("_j") * DIGITS + 1
    first = (F.col("_u") >= F.col("_tree.low")) & (F.col("_u") < F.col("_tree.high"))
    later = F.col("_u") < F.col("_tree.low")
    if chance < 1.0:  # digits compare as their number does, and need not be turned into it
        later &= F.substr("_digest", place, F.lit(DIGITS)) < F.lit(f"{math.ceil(chance * 16**DIGITS):0{DIGITS}x}")
    number = _unit(F.col("_digest"), place)
    drawn = pairs.where(first | later).select(
        *key, *columns, "_tree.tree_id", F.when(first, number * F.lit(chance)).otherwise(number).alias("_number"))
    order = Window.partitionBy("tree_id").orderBy("_number", *key)
    return (drawn.withColumn("place", F.row_number().over(order)).where(F.col("place") <= take)
            .select("tree_id", "place", *columns))


# ---- trees -------------------------------------------------------------------------------
def node_draws(seed: int, tree: int, node: int) -> tuple[float, float]:
    """Two numbers in [0, 1): the choice of the feature and the place of the cut."""
    digest = hashlib.sha256(f"{seed}|{tree}|{node}".encode()).hexdigest()
    return int(digest[:DIGITS], 16) / 16**DIGITS, int(digest[DIGITS:2 * DIGITS], 16) / 16**DIGITS


def grow_tree(x: np.ndarray, seed: int, tree: int, limit: int) -> list[tuple[int, int, float, int, int]]:
    """Splits until a node is pure, single or at the depth limit. Children of node i
    are 2i+1 (value <= threshold) and 2i+2; a leaf has feature -1."""
    nodes, todo = [], [(0, np.arange(len(x)), 0)]
    while todo:
        node, rows, depth = todo.pop()
        part = x[rows]
        low, high = part.min(axis=0), part.max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or not len(usable):
            nodes.append((node, -1, 0.0, len(rows), depth))
            continue
        choice, place = node_draws(seed, tree, node)
        f = int(usable[int(choice * len(usable))])
        cut = float(low[f] + place * (high[f] - low[f]))
        left = part[:, f] <= cut
        nodes.append((node, f, cut, len(rows), depth))
        todo += [(2 * node + 1, rows[left], depth + 1), (2 * node + 2, rows[~left], depth + 1)]
    return nodes


def fit_forest(df: DataFrame, columns: Sequence[str], key: Sequence[str], n_rows: int,
               cfg: EngineConfig) -> DataFrame:
    """Node table of the forest; its size is fixed by the settings, not by the data. Thresholds
    are in units of the grid."""
    names, limit, seed = list(columns), depth_limit(cfg, min(cfg.tree_rows, n_rows)), cfg.seed
    df = df.withColumns({c: on_grid(F.col(c)) for c in names})

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree_id"].iloc[0])
        nodes = grow_tree(pdf[names].to_numpy(float), seed, tree, limit)
        out = pd.DataFrame(nodes, columns=["node_id", "feature", "threshold", "rows", "depth"])
        return out.assign(tree_id=tree)[["tree_id", "node_id", "feature", "threshold", "rows", "depth"]]

    return tree_samples(df, names, key, n_rows, cfg).groupBy("tree_id").applyInPandas(build, NODE_SCHEMA)


# ---- scoring -----------------------------------------------------------------------------
class PackedForest(NamedTuple):
    """The node table as complete binary trees of arrays, for vectorised descent.

    A threshold is given as its place among the distinct ones of its feature. A value is put in
    its place among them once, and every step then compares two small whole numbers.
    """

    feature: np.ndarray          # tree x inner node
    place: np.ndarray            # tree x inner node; NOWHERE where a leaf sits above the last level
    path: np.ndarray             # tree x last level: path length of the leaf that ends there
    norm: float
    cuts: tuple[np.ndarray, ...]  # the distinct thresholds of each feature in order


NOWHERE = np.iinfo(np.int32).max


def pack_forest(nodes: pd.DataFrame, tree_rows: int) -> PackedForest:
    levels = int(nodes["depth"].max())
    trees = np.sort(nodes["tree_id"].unique())
    inner = 2**levels - 1
    feature = np.zeros((len(trees), inner), dtype=np.int32)
    cut_place = np.full((len(trees), inner), NOWHERE, dtype=np.int32)
    path = np.zeros((len(trees), inner + 1))
    place = np.searchsorted(trees, nodes["tree_id"].to_numpy())
    node, depth = nodes["node_id"].to_numpy(), nodes["depth"].to_numpy()
    chosen, threshold = nodes["feature"].to_numpy(), nodes["threshold"].to_numpy()
    split = chosen >= 0
    feature[place[split], node[split]] = chosen[split]
    cuts = tuple(np.unique(threshold[chosen == f]) for f in range(chosen.max(initial=-1) + 1))
    for f, own in enumerate(cuts):
        mine = chosen == f
        cut_place[place[mine], node[mine]] = np.searchsorted(own, threshold[mine])
    # below a leaf every step goes left, so its path length belongs at the leftmost slot
    steps = levels - depth[~split]
    slot = (node[~split] + 1) * 2**steps - 1 - inner
    path[place[~split], slot] = depth[~split] + mean_path(nodes["rows"].to_numpy()[~split])
    return PackedForest(feature, cut_place, path, float(mean_path(tree_rows)) or 1.0, cuts)


def anomaly(forest: PackedForest, x: np.ndarray) -> np.ndarray:
    """2^(-mean path / normal path): near 1 is anomalous, 0.5 and below is ordinary."""
    n, inner = len(x), forest.feature.shape[1]
    passed = np.zeros((max(len(forest.cuts), 1), n), dtype=np.int32)  # thresholds below the value; none below NaN
    for own, cuts, column in zip(passed, forest.cuts, x.T):
        own[:] = np.where(np.isnan(column), 0, np.searchsorted(cuts, column))
    flat, rows, total = passed.ravel(), np.arange(n), np.zeros(n)
    cell, value, limit = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int32), np.empty(n, dtype=np.int32)
    for start, place, path in zip(forest.feature.astype(np.int64) * n, forest.place, forest.path):
        at = np.zeros(n, dtype=np.int64)
        for _ in range(inner.bit_length()):  # all rows go down level by level
            np.add(start.take(at, out=cell, mode="clip"), rows, out=cell)
            right = flat.take(cell, out=value, mode="clip") > place.take(at, out=limit, mode="clip")
            at += at
            at += 1
            at += right
        total += path[at - inner]
    return 2.0 ** (-(total / len(forest.path)) / forest.norm)


def forest_score(nodes: pd.DataFrame, columns: Sequence[Column], tree_rows: int, spark) -> Column:
    """Raw anomaly score as an Arrow UDF; the packed trees (a few MB, fixed) are broadcast as
    plain arrays."""
    packed = spark.sparkContext.broadcast(tuple(pack_forest(nodes, tree_rows)))

    @F.pandas_udf("double")
    def raw(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        trees = PackedForest(*packed.value)
        for batch in batches:
            yield pd.Series(anomaly(trees, np.column_stack(batch)))

    return raw(*map(on_grid, columns))
