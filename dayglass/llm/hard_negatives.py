"""Hard negatives for anchors: rows of another label that score nearly as high as a positive.

A score is the inner product of two vectors of whole numbers, floor(256 c). Rows are packed where
they are read into blocks of at most `BLOCK_ROWS`, anchors into blocks of about `ANCHOR_ROWS`; an anchor
block beside a row block is a tile. Tiles are dealt over tasks by anchor block and group of about
`GROUP_BLOCKS` row blocks, whatever the labels, ids and vectors, so none of these gathers anywhere,
and a task holds one tile at a time. A tile's scores are a matrix product by Strassen's recursion on 64-bit integers, odd sizes padded
with zeros, small ones multiplied directly. Sums and differences wrap round alike in every step,
so scores are exact whenever they fit 64 bits themselves.

Scores go into heaps of the `POSITIVES` best rows of the same label for each anchor, which are
merged over tasks. Their scores open windows, and a second pass over the tiles fills a heap of the
`NEGATIVES` best rows of other labels within each window. Higher scores come first, then lesser
ids, then the row's place in the packed table; what a heap has already bounds what is looked at.

Defined results: rows with a null label, null vector, null or non-finite component take no part,
nor do vectors of another length than the commonest (of equally common ones the shortest) or with
components of 2^24 or more (65,536 unscaled) or 16,384 dimensions or more, which keeps scores within
64 bits. Rows with a null id are no anchors and come last among ties. Repeated rows are rows of their own: each may be positive or negative, and each
is an anchor that leaves out itself alone. A positive score below 0 has an empty window. Empty
tables and tables without anchors give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import materialize
from .common import map_columns, table
from .whitening import VECTOR, matrix, quantized

POSITIVES, NEGATIVES = 5, 5
LOW, HIGH, OF = 80, 100, 100  # a negative's score lies between LOW/OF and HIGH/OF of the positive's
ANCHOR_EVERY = 100
BLOCK_ROWS, ANCHOR_ROWS, GROUP_BLOCKS = 2048, 512, 4
LARGEST, DIMENSIONS = 1 << 24, 1 << 14  # scores stay below 2^62
LEAF = 32
NONE = np.iinfo(np.int64).min  # score of an empty entry
LAST = np.iinfo(np.int64).max  # stands for a null id
PACKED = "block long, ids binary, labels binary, vectors binary"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


# ---- matrix products
def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b of 64-bit integers, by seven products of half the size."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    if m % 2 or k % 2 or n % 2:  # a row or column of zeros makes each size even
        a, b = np.pad(a, ((0, m % 2), (0, k % 2))), np.pad(b, ((0, k % 2), (0, n % 2)))
    i, j, c = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :c], b[:j, c:], b[j:, :c], b[j:, c:]
    p1, p2 = strassen(a11 + a22, b11 + b22, leaf), strassen(a21 + a22, b11, leaf)
    p3, p4 = strassen(a11, b12 - b22, leaf), strassen(a22, b21 - b11, leaf)
    p5, p6 = strassen(a11 + a12, b22, leaf), strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * i, 2 * c), np.int64)
    out[:i, :c], out[:i, c:] = p1 + p4 - p5 + p7, p3 + p5
    out[i:, :c], out[i:, c:] = p2 + p4, p1 - p2 + p3 + p6
    return out[:m, :n]


# ---- heaps
class Heaps:
    """For each of several owners the `size` best entries so far, best first: score, id and place
    (number of the row in the packed table). Empty entries have the score NONE."""

    def __init__(self, owners: int, size: int, entries: np.ndarray | None = None):
        self.entries = np.tile(np.array([NONE, LAST, LAST]), (owners, size, 1)) if entries is None else entries

    def merge(self, other: np.ndarray, owners=slice(None)) -> None:
        """Keep the best of own and other entries (owner, any number, 3)."""
        both = np.concatenate([self.entries[owners], other], axis=1)
        order = np.lexsort((both[..., 2], both[..., 1], ~both[..., 0]), axis=1)[:, :self.entries.shape[1]]
        self.entries[owners] = np.take_along_axis(both, order[..., None], axis=1)

    def push(self, owners: np.ndarray, scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray, places: np.ndarray) -> None:
        """The allowed ones of a matrix of scores, a row for each of `owners` and a column for each
        table row, columns in order of id and place."""
        size = self.entries.shape[1]
        seen = np.where(allowed, scores, NONE)
        least = self.entries[owners, -1, 0]  # what a score must reach to get in
        if scores.shape[1] > size:
            least = np.maximum(least, np.partition(seen, -size, axis=1)[:, -size])
        row, column = np.nonzero(allowed & (seen >= least[:, None]))
        order = np.lexsort((column, ~seen[row, column], row))
        row, column = row[order], column[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        row, column, rank = (x[rank < size] for x in (row, column, rank))
        new = Heaps(len(owners), size).entries
        new[row, rank] = np.stack([seen[row, column], ids[column], places[column]], axis=1)
        some = np.unique(row)
        self.merge(new[some], owners[some])


# ---- blocks and tiles
def numbers_of(packed: bytes | None) -> np.ndarray:
    return np.frombuffer(packed or b"", np.int64)


def row_blocks(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows (id, label, `_x`) packed by the tasks that read them, in order of id within a block."""
    def work(batches):
        from pyspark import TaskContext

        number, held, n = TaskContext.get().partitionId() << 24, [], 0

        def finish() -> list:
            ids, labels, vectors = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(ids, kind="stable")
            return [[number], [ids[order].tobytes()], [labels[order].tobytes()], [vectors[order].tobytes()]]

        for batch in (b.slice(at, block_rows) for b in batches for at in range(0, b.num_rows, block_rows)):
            if n and n + batch.num_rows > block_rows:
                yield finish()
                number, held, n = number + 1, [], 0
            held.append((batch["id"].to_numpy(), batch["label"].to_numpy(), matrix(batch)))
            n += batch.num_rows
        if n:
            yield finish()

    return map_columns(rows.select("id", "label", VECTOR), PACKED, work)


def anchor_blocks(blocks: DataFrame, every: int, block_rows: int, anchor_rows: int) -> tuple[DataFrame, int]:
    """Anchors of packed rows in blocks of their own (a, ids, labels, places, vectors), and the
    number of blocks that they are dealt to."""
    def pick(batches):
        for batch in batches:
            for block, *packed in zip(*(batch[c].to_pylist() for c in batch.schema.names)):
                ids, labels, vectors = map(numbers_of, packed)
                at = np.flatnonzero((ids % every == 0) & (ids != LAST))
                vectors = vectors.reshape(len(ids), -1)[at]
                yield [ids[at], labels[at], block * block_rows + at, [v.tobytes() for v in vectors]]

    anchors = materialize(map_columns(blocks, "id long, label long, place long, vector binary", pick), "negatives-anchors")
    n = -(-anchors.count() // anchor_rows)
    dealt = anchors.withColumn("a", F.pmod(F.xxhash64("place"), F.lit(max(1, n))).cast("int"))  # places are distinct, so blocks come out even

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by("place")
        columns = [group[c].to_numpy().tobytes() for c in ("id", "label", "place")] + [b"".join(group["vector"].to_pylist())]
        return pa.table([group["a"][:1].combine_chunks(), *(pa.array([c], pa.binary()) for c in columns)], ["a", "ids", "labels", "places", "vectors"])

    packed = dealt.groupBy("a").applyInArrow(pack, "a int, ids binary, labels binary, places binary, vectors binary")
    return materialize(packed, "negatives-anchor-blocks"), n


def tiles(blocks: DataFrame, n_blocks: int, anchors: DataFrame, n_anchors: int, group_blocks: int) -> DataFrame:
    """Rows ordered by anchor block `a` and group: first the anchor block, with null `block`, then
    the row blocks of the group. Every row block meets every anchor block once."""
    groups = max(1, -(-n_blocks // group_blocks))

    def each(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    group = F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int").alias("group")
    left = blocks.select(each(n_anchors).alias("a"), group, "*")
    right = anchors.select("a", each(groups).alias("group"), *(c for c in anchors.columns if c != "a"))
    both = left.unionByName(right, allowMissingColumns=True)
    return both.repartition("a", "group").sortWithinPartitions("a", "group", F.col("block").asc_nulls_first())


def tile_heaps(tiled: DataFrame, windows: int, size: int, block_rows: int, fill) -> DataFrame:
    """a, heaps (packed): `windows` heaps of `size` for each anchor, which `fill` has pushed the
    scores of all tiles into. Each task merges over its tiles, then the heaps of tasks are merged."""
    def over_tiles(batches):
        last, anchor, heaps = None, {}, None
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch[c][k].as_py() for c in batch.schema.names}
                a, block = row.pop("a"), row.pop("block")
                row = {c: numbers_of(x) for c, x in row.items() if c != "group"}
                if block is None:
                    anchor = row
                    if a != last:
                        if heaps is not None:
                            yield [[last], [heaps.entries.tobytes()]]
                        last, heaps = a, Heaps(len(anchor["ids"]) * windows, size)
                elif a == last:  # else an anchor block that no anchor was dealt to
                    left = anchor["vectors"].reshape(len(anchor["ids"]), -1)
                    right = row["vectors"].reshape(len(row["ids"]), -1)
                    scores = strassen(left, np.ascontiguousarray(right.T))
                    fill(heaps, anchor, scores, row["ids"], row["labels"], block * block_rows + np.arange(len(right)))
        if heaps is not None:
            yield [[last], [heaps.entries.tobytes()]]

    def over_tasks(batches):
        last, heaps = None, None
        for batch in batches:
            for a, held in zip(batch["a"].to_pylist(), batch["heaps"].to_pylist()):
                entries = numbers_of(held).reshape(-1, size, 3)
                if a == last:
                    heaps.merge(entries)
                else:
                    if heaps is not None:
                        yield [[last], [heaps.entries.tobytes()]]
                    last, heaps = a, Heaps(0, size, entries.copy())
        if heaps is not None:
            yield [[last], [heaps.entries.tobytes()]]

    of_tasks = map_columns(tiled, "a int, heaps binary", over_tiles)
    return map_columns(of_tasks.repartition("a").sortWithinPartitions("a"), "a int, heaps binary", over_tasks)


def hard_negatives(rows: DataFrame, every: int = ANCHOR_EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
                   of: int = OF, block_rows: int = BLOCK_ROWS, anchor_rows: int = ANCHOR_ROWS, group_blocks: int = GROUP_BLOCKS) -> DataFrame:
    """For rows (id, label, embedding) RESULT: the first `negatives` of each anchor and positive."""
    usable = quantized(rows.where("label IS NOT NULL"), largest=LARGEST).where(F.size(VECTOR) < DIMENSIONS)
    length = usable.groupBy(F.size(VECTOR).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    spark = rows.sparkSession
    if length is None:
        return spark.createDataFrame([], RESULT)
    usable = usable.where(F.size(VECTOR) == length.d).select(
        F.coalesce(F.col("id").cast("long"), F.lit(int(LAST))).alias("id"), F.col("label").cast("long").alias("label"), VECTOR)
    blocks = materialize(row_blocks(usable, block_rows), "negatives-blocks")
    anchors, n_anchors = anchor_blocks(blocks, every, block_rows, anchor_rows)
    if not n_anchors:
        return spark.createDataFrame([], RESULT)
    n_blocks = blocks.count()

    def fill_positives(heaps, anchor, scores, ids, labels, places):
        allowed = (labels == anchor["labels"][:, None]) & (places != anchor["places"][:, None])
        heaps.push(np.arange(len(scores)), scores, allowed, ids, places)

    def fill_windows(heaps, anchor, scores, ids, labels, places):
        best = anchor["positives"].reshape(-1, positives, 3)[..., 0]
        other = labels != anchor["labels"][:, None]
        for k in range(positives):
            some = np.flatnonzero(best[:, k] != NONE)
            bounds = [(-(-low * p // of), high * p // of) for p in best[some, k].tolist()]  # Python integers: no product leaves 64 bits
            least, most = np.array(bounds, np.int64).reshape(-1, 2).T[..., None]
            allowed = other[some] & (scores[some] >= least) & (scores[some] <= most)
            some_left = allowed.any(axis=1)
            heaps.push(some[some_left] * positives + k, scores[some][some_left], allowed[some_left], ids, places)

    found = tile_heaps(tiles(blocks, n_blocks, anchors, n_anchors, group_blocks), 1, positives, block_rows, fill_positives)
    anchors = materialize(anchors.join(found.withColumnRenamed("heaps", "positives"), "a"), "negatives-positives")
    windows = tile_heaps(tiles(blocks, n_blocks, anchors, n_anchors, group_blocks), positives, negatives, block_rows, fill_windows)

    def written(batches):
        for batch in batches:
            for ids, best, held in zip(*(batch[c].to_pylist() for c in ("ids", "positives", "heaps"))):
                ids, best = numbers_of(ids), numbers_of(best).reshape(-1, positives, 3)
                held = numbers_of(held).reshape(len(ids), positives, negatives, 3)
                a, p, n = np.nonzero(held[..., 0] != NONE)
                yield [ids[a], no_id(best[a, p, 1]), n.astype(np.int32) + 1, no_id(held[a, p, n, 1]), best[a, p, 0], held[a, p, n, 0]]

    def no_id(ids: np.ndarray) -> pa.Array:
        return pa.array(ids, pa.int64(), mask=ids == LAST)

    return map_columns(anchors.join(windows, "a").select("ids", "positives", "heaps"), RESULT, written)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.coalesce(F.col("vec_id") % 7 == 0, F.lit(False))
    label = F.when(moved, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select(F.col("vec_id").alias("id"), label.alias("label"), "embedding"))


ORACLE = f"""
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
         list_sum(list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM usable a JOIN usable b ON a.vec_id % {ANCHOR_EVERY} = 0 AND a.vec_id <> b.vec_id
), positive AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES}
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM (
  SELECT p.anchor_id, p.positive_id, (row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id))::INT AS rank,
         s.id AS negative_id, p.positive_score, s.score AS negative_score
  FROM positive p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.same
    AND {LOW} * p.positive_score <= {OF} * s.score AND {OF} * s.score <= {HIGH} * p.positive_score
) WHERE rank <= {NEGATIVES}
"""
