"""N-gram Jaccard join with a MinHash LSH forest and exact verification.

A text is the set of its 5-word shingles (words between white space, A-Z lower-cased; a shorter
text is one shingle of all its words), kept as 64-bit hashes. Texts with equal sets form a class,
and only classes are compared. Each of `TREES` tries holds a label for each class: the low bytes
of `DEPTH` minimum hashes, in order, so that a prefix of a label is a node of the trie.

The prefix at which a pair at the threshold itself shares a node in some trie with the target
recall is the shortest in use. Nodes of that length with two classes or more are found by counting,
and their members sorted by label; only these few classes go on. A pair is met at the longest
prefix it shares in any trie, in the first trie where it shares that much, which its labels tell.
Pairs met at full labels are verified first; then prefixes are shortened byte by byte. From
the likeness s of the pairs found so far follows how many there are, as each is found with chance
1-(1-s^length)^TREES. A class whose recall so estimated, with one more pair at the threshold taken
for granted, has reached the target asks no further; classes without links go on to the shortest
prefix, and whoever still asks is compared with all others at the node.

Candidates are verified exactly, node by node, without writing pairs: a task gets the shingles of
a node, counts all common shingles by sparse and dense products, and returns for each class the
rows it links to and one edge towards its group. A node with more than `TILE_SHINGLES` shingles is
cut into groups, each pair of groups a task of its own.

Defined results: null, empty and wordless texts have no shingles, no links, and form classes of
their own; copies count as links; repeated rows are copies; a null id is never a class id unless
the whole group has null ids; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..session import materialize
from .common import Memo, id_filter, map_columns, may_hold, table, whole_text, with_columns
from .components import connected_components

WORDS, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL = 24, 8, 0.9999
TILE_SHINGLES, TILE_ROWS = 1 << 20, 2048
SEED = 20250
COLUMN_CHUNK, SPARSE, PAIR_CHUNK = 4096, 16, 1 << 16
CANDIDATE = "length int, tree int, node long, tile long, parts int, side int, key binary, rows long, labels array<long>"


def prefix_length(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix at which a pair at the threshold meets with the target recall."""
    while depth > 1 and 1 - (1 - threshold ** depth) ** trees < recall:
        depth -= 1
    return depth


def shingles(text: str, memo: Memo) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    size = min(WORDS, len(words))
    mixed = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        mixed = (mixed ^ hashes[k:len(words) - size + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def set_key(hashes: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else None


def chance(likeness, length: int, trees: int = TREES):
    """That a pair shares a prefix of this length in some trie."""
    return 1 - (1 - likeness ** length) ** trees


class Forest:
    """Labels of a shingle set, one for each trie."""

    def __init__(self, trees: int, depth: int):
        draw = np.random.default_rng(SEED)
        self.trees, self.depth = trees, depth
        self.factors = draw.integers(0, 1 << 31, trees * depth, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.offsets = draw.integers(0, 1 << 32, trees * depth, dtype=np.uint32)

    def labels(self, hashes: np.ndarray) -> np.ndarray:
        low = np.full(self.trees * self.depth, 0xFFFFFFFF, np.uint32)
        short = (hashes >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(short), 256):
            block = short[at:at + 256, None] * self.factors[None, :] + self.offsets[None, :]
            np.minimum(low, block.min(axis=0), out=low)
        return np.ascontiguousarray(low.astype(np.uint8)).view(">u8").astype(np.uint64).view(np.int64)


def word_memo() -> Memo:
    return Memo(lambda w: xxhash.xxh64_intdigest(w))


def signatures(docs: DataFrame, trees: int = TREES) -> DataFrame:
    """doc_id, set key (null without words), number of shingles, labels."""
    def work(batches):
        forest, memo = Forest(trees, DEPTH), word_memo()
        for batch in batches:
            sets = [shingles(x, memo) for x in batch["text"].to_pylist()]
            yield [batch["doc_id"], [set_key(x) for x in sets], [len(x) for x in sets],
                   [forest.labels(x) if len(x) else None for x in sets]]

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return map_columns(rows, "doc_id long, key binary, n_shingles int, labels array<long>", work)


def prefix_of(label, length: int):
    """The node of a label at a prefix of so many bytes."""
    return F.shiftrightunsigned(label, 8 * (DEPTH - length))


def shared_nodes(classes: DataFrame, length: int) -> DataFrame:
    """Members of the nodes with at least two classes: tree, node, parts (groups it is cut into),
    key, rows, labels. Only tree, label and key of all classes are dealt by node."""
    spread = classes.select("key", F.posexplode("labels").alias("tree", "label")).select("tree", prefix_of("label", length).alias("node"), "key")
    nodes = spread.groupBy("tree", "node").agg(F.count("*").alias("n")).where("n > 1")
    members = spread.join(nodes, ["tree", "node"]).join(classes.select("key", "rows", "n_shingles", "labels"), "key")
    members = materialize(members, "jaccard-members")
    sizes = members.groupBy("tree", "node").agg(F.sum("n_shingles").alias("total"), F.first("n").alias("n")).select(
        "tree", "node", F.ceil(F.greatest(F.col("total") / TILE_SHINGLES, F.col("n") / TILE_ROWS)).cast("int").alias("parts"))
    return members.drop("n", "n_shingles").join(sizes, ["tree", "node"])


def tiles(members: DataFrame) -> DataFrame:
    """One row for each task a member takes part in; `side` tells which of the task's groups."""
    own = F.pmod(F.xxhash64(F.lit(7), "key"), F.col("parts")).cast("int")
    spread = members.withColumn("side", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return spread.withColumn("tile", F.least("side", "_other").cast("long") * F.col("parts") + F.greatest("side", "_other")).drop("_other")


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of the numbers of common shingles of all pairs of sets."""
    m = len(sets)
    owner = np.repeat(np.arange(m, dtype=np.int32), [len(x) for x in sets])
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    starts = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
    sizes = np.diff(np.append(starts, len(every)))
    out = np.zeros((m, m), np.float32)
    for size in range(2, SPARSE + 1):  # shingles of few sets: count their pairs
        columns = owner[starts[sizes == size][:, None] + np.arange(size)]
        if len(columns):
            a, b = np.triu_indices(size, 1)
            for at in range(0, len(columns), 1 << 16):
                part = columns[at:at + (1 << 16)]
                flat = part[:, a].astype(np.int64) * m + part[:, b]
                if m * m <= 1 << 22:
                    out += np.bincount(flat.ravel(), minlength=m * m).reshape(m, m)
                else:
                    cells, times = np.unique(flat, return_counts=True)
                    out.ravel()[cells] += times
    out += out.T
    wide = np.flatnonzero(sizes > SPARSE)  # shingles of many sets: dense products
    for at in range(0, len(wide), COLUMN_CHUNK):
        part = wide[at:at + COLUMN_CHUNK]
        dense = np.zeros((m, len(part)), np.float32)
        for j, k in enumerate(part):
            dense[owner[starts[k]:starts[k] + sizes[k]], j] = 1
        out += dense @ dense.T
    return out


def met_at(labels: np.ndarray, a: np.ndarray, b: np.ndarray, tree: int, least: int) -> np.ndarray:
    """The length of the prefix that members a and b share in `tree` if this is where they meet:
    no trie has a longer one, no earlier trie one as long. Else, or below `least`, 0."""
    apart = labels[a] ^ labels[b]
    length = np.zeros(apart.shape, np.int8)
    for n in range(least, DEPTH + 1):
        length += apart < np.uint64(1 << 8 * (DEPTH - n))  # the first n bytes are equal
    own = length[:, tree]
    first = (own > 0) & (length[:, :tree] < own[:, None]).all(axis=1) & (length[:, tree:] <= own[:, None]).all(axis=1)
    return np.where(first, own + (least - 1), 0)


def label_matrix(rows: list[list[int]]) -> np.ndarray:
    return np.array(rows, np.int64).view(np.uint64)


def meetings(tiled: DataFrame, least: int) -> DataFrame:
    """CANDIDATE: the members of each node, at the prefix length where they meet another one, that
    are to be compared there. Labels alone decide it."""
    def found_in(tree: int, tile: int, held: list) -> Iterator[list]:
        parts, side = held[0][0], np.array([x[1] for x in held])
        labels, diagonal = label_matrix([x[4] for x in held]), tile // parts == tile % parts
        flags = np.zeros((DEPTH + 1, len(held)), bool)
        rows = max(1, PAIR_CHUNK // len(held))
        for at in range(0, len(held), rows):
            a, b = (x.ravel() for x in np.mgrid[at:min(at + rows, len(held)), :len(held)])
            new = a < b if diagonal else (a < b) & (side[a] != side[b])
            a, b = a[new], b[new]
            length = met_at(labels, a, b, tree, least)
            flags[length, a] = flags[length, b] = True
        length, member = np.nonzero(flags[least:])
        length += least
        if len(member):
            node = labels[member, tree] >> (8 * (DEPTH - length)).astype(np.uint64)
            chosen = [held[i] for i in member]
            yield [length, np.full(len(member), tree), node.view(np.int64), np.full(len(member), tile), *([x[k] for x in chosen] for k in range(5))]

    def work(batches):
        rows = (row for batch in batches for row in zip(*(batch[c].to_pylist() for c in ("tree", "node", "tile", "parts", "side", "key", "rows", "labels"))))
        for (tree, _, tile), own in groupby(rows, itemgetter(0, 1, 2)):
            held = [row[3:] for row in own]
            if len(held) > 1:
                yield from found_in(tree, tile, held)

    label = F.get("labels", F.col("tree"))
    ordered = tiled.repartition("tree", "node", "tile").sortWithinPartitions("tree", "node", "tile", label)
    return map_columns(ordered, CANDIDATE, work)


def verify_tile(tree: int, length: int, diagonal: bool, side: np.ndarray, rows: np.ndarray, labels: np.ndarray, sets: list[np.ndarray],
                threshold: float, least: int) -> tuple[np.ndarray, ...]:
    """Members with links in this tile, the rows they link to, a member of their group, the
    classes they link to and how many these stand for."""
    common = common_counts(sets)
    sizes = np.array([len(x) for x in sets], np.float32)
    good = common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-4
    np.fill_diagonal(good, False)
    if not diagonal:
        good &= side[:, None] != side[None, :]
    a, b = np.nonzero(good)
    here = np.concatenate([np.empty(0, bool), *(met_at(labels, a[at:at + PAIR_CHUNK], b[at:at + PAIR_CHUNK], tree, least) == length for at in range(0, len(a), PAIR_CHUNK))])
    a, b = a[here], b[here]
    links = np.bincount(a, weights=rows[b], minlength=len(sets)).astype(np.int64)
    likeness = common[a, b] / (sizes[a] + sizes[b] - common[a, b])
    found, stands = np.bincount(a, minlength=len(sets)), np.bincount(a, weights=1 / chance(likeness.astype(float), length, labels.shape[1]), minlength=len(sets))
    root = np.arange(len(sets))
    while len(a):
        before = root.copy()
        np.minimum.at(root, a, root[b])
        root = root[root]
        if (root == before).all():
            break
    linked = np.unique(a)
    return linked, links[linked], root[linked], found[linked], stands[linked]


def verified_links(candidates: DataFrame, threshold: float, least: int) -> DataFrame:
    """key, links, root (a linked key of the same tile), found, stands for all members with links,
    tile by tile."""
    def work(batches):
        names = ("tree", "node", "tile", "length", "parts", "side", "key", "rows", "labels", "hashes")
        every = (row for batch in batches for row in zip(*(batch[c].to_pylist() for c in names)))
        for (tree, _, tile, length), own in groupby(every, itemgetter(0, 1, 2, 3)):
            parts, side, keys, rows, labels, hashes = zip(*(row[4:] for row in own))
            if len(keys) > 1:
                linked, links, root, found, stands = verify_tile(
                    tree, length, tile // parts[0] == tile % parts[0], np.array(side), np.array(rows, np.float64), label_matrix(labels),
                    [np.frombuffer(x, np.uint64) for x in hashes], threshold, least)
                yield [[keys[i] for i in linked], links, [keys[i] for i in root], found, stands]

    ordered = candidates.repartition("tree", "node", "tile").sortWithinPartitions("tree", "node", "tile")
    return map_columns(ordered, "key binary, links long, root binary, found long, stands double", work)


def descend(candidates: DataFrame, sets: DataFrame, threshold: float, trees: int, least: int, recall: float = RECALL) -> DataFrame:
    """The verified links of all lengths, from whole labels to prefixes of `least` bytes; a class
    that has reached the recall asks no further."""
    every, done = None, None
    for length in range(DEPTH, least - 1, -1):
        rows = candidates.where(F.col("length") == length)
        if done is not None:  # nodes where someone still asks; a tile has TILE_ROWS members at most on either side
            asks = F.max(F.col("_done").isNull()).over(W.partitionBy("tree", "node", "tile"))
            rows = rows.join(done, "key", "left").withColumn("_asks", asks).where("_asks").drop("_asks", "_done")
        links = materialize(verified_links(rows.join(sets, "key"), threshold, least), "jaccard-links")
        every = links if every is None else every.unionByName(links)
        if length > least:
            enough = (F.sum("found") + chance(threshold, length, trees)) / (F.sum("stands") + 1) >= recall
            done = materialize(every.groupBy("key").agg(enough.alias("_done")).where("_done"), "jaccard-done")
    return every


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """key, hashes (packed) of the classes in `wanted` (key, doc_id of one of its rows)."""
    shared = docs.sparkSession.sparkContext.broadcast(id_filter(wanted.select(F.xxhash64("doc_id").alias("_h"))))

    def work(batches):
        memo = word_memo()
        for batch in batches:
            batch = batch.filter(pa.array(may_hold(shared.value, batch["_h"].to_numpy())))
            sets = [shingles(x, memo) for x in batch["text"].to_pylist()]
            yield [[set_key(x) for x in sets], [x.tobytes() for x in sets]]

    rows = docs.select(F.xxhash64(F.col("doc_id").cast("long")).alias("_h"), whole_text().alias("text"))
    sets = map_columns(rows, "key binary, hashes binary", work)
    return sets.where("key IS NOT NULL").join(wanted.select("key"), "key", "left_semi").dropDuplicates(["key"])


def classify(docs: DataFrame, threshold: float = THRESHOLD, trees: int = TREES) -> DataFrame:
    """doc_id, key, root (the same in a group), class_id (least id of its group), n_links (other rows at the threshold), n_copies."""
    least = prefix_length(threshold, trees)
    signed = materialize(signatures(docs, trees), "jaccard-signatures")
    classes = signed.where("key IS NOT NULL").groupBy("key").agg(
        F.min("doc_id").alias("doc_id"), F.count("*").alias("rows"), F.first("n_shingles").alias("n_shingles"), F.first("labels").alias("labels"))
    classes = materialize(classes, "jaccard-classes")
    candidates = materialize(meetings(tiles(shared_nodes(classes, least)), least), "jaccard-candidates")
    wanted = materialize(classes.select("key", "doc_id").join(candidates.select("key").distinct(), "key", "left_semi"), "jaccard-wanted")
    sets = materialize(shingle_sets(docs, wanted), "jaccard-sets")
    links = descend(candidates, sets, threshold, trees, least)
    groups = connected_components(links.select(F.col("key").alias("u"), F.col("root").alias("v")))
    per_key = (classes.select("key", "doc_id", "rows")
               .join(groups.withColumnRenamed("node", "key"), "key", "left")
               .join(links.groupBy("key").agg(F.sum("links").alias("links")), "key", "left")
               .withColumn("root", F.coalesce("root", "key")))
    least = per_key.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    per_key = per_key.join(least, "root").select(
        F.col("key"), "root", "class_id", (F.coalesce("links", F.lit(0)) + F.col("rows") - 1).alias("n_links"), F.col("rows").alias("n_copies"))
    rows = signed.select("doc_id", "key").join(per_key, "key", "left")
    return rows.select("doc_id", "key", "root", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                       F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"))


def deduplicate(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with one document of each group: the one with the least id (of repeated rows one).
    Where an id occurs more than once, its rows are told apart by their sets of shingles.
    Texts without words all stay. Rows without an id stay if no row of their group has one, one
    for each set of shingles."""
    judged = materialize(classify(docs, threshold), "jaccard-judged")
    columns = docs.columns
    goes = F.col("key").isNotNull() & ((F.col("doc_id") != F.col("class_id")) | (F.col("n_copies") > 1))
    ids = judged.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(
        F.count("*").alias("_rows"), F.max(goes).alias("_goes"), F.max(F.col("doc_id") == F.col("class_id")).alias("_stays")).where("_goes OR _rows > 1")
    named = docs.where("doc_id IS NOT NULL").join(ids, F.col("doc_id") == F.col("_id"), "left")
    whole = named.where("_id IS NULL")
    chosen = named.where("_rows = 1 AND _stays")
    # one row of each group, where its least id occurs more than once
    least = judged.where("doc_id = class_id AND key IS NOT NULL").groupBy(F.col("doc_id").alias("_least"), "root").agg(F.min("key").alias("_least_key"))
    nameless = docs.where("doc_id IS NULL")
    keys = judged.where("doc_id IS NULL AND class_id IS NULL AND key IS NOT NULL").select("key").distinct()

    def key_of(batch: pa.RecordBatch, memo: Memo) -> list:
        return [[set_key(shingles(x or "", memo)) for x in batch["text"].to_pylist()]]

    keyed = with_columns(nameless, "_key binary", key_of, word_memo)
    alone = keyed.where("_key IS NULL").select(columns)
    first = keyed.join(keys, keyed["_key"] == keys["key"], "left_semi").dropDuplicates(["_key"]).select(columns)
    several = with_columns(named.where("_rows > 1").drop("_rows", "_goes", "_stays"), "_key binary", key_of, word_memo)
    wordless = several.where("_key IS NULL").select(columns)
    kept = several.join(least, (F.col("_id") == F.col("_least")) & (F.col("_key") == F.col("_least_key")), "left_semi").dropDuplicates(["_id", "_key"])
    for part in (chosen, alone, first, wordless, kept):
        whole = whole.select(columns).unionByName(part.select(columns))
    return whole


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs).select("doc_id", "class_id", "n_links", "n_copies")
