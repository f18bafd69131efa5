"""Language-model scores by prediction by partial matching (PPM).

The model is a trie of byte contexts up to `ORDER` bytes, held as tables: for each context and
following byte the number of training occurrences. After n occurrences of d distinct bytes, one that came
c times has probability (2c-1)/2n, and d/2n is left to escape (method D): any other byte is then
looked for after the next shorter context, where the bytes seen after the longer one are excluded; below order 0
the remaining byte values are equally likely. With all counts fixed, the probability of a byte
depends on the `ORDER` bytes before it alone, so it is computed once for each distinct window.

Documents are packed into blocks of about `BLOCK_CHARS` bytes by the tasks that read them. A block
states its distinct windows and words with their training counts, cut into buckets: windows by the
`SHARED` bytes before the last one, words by hash. A bucket's runs from all blocks are merged; the
trie's levels up to SHARED + 1 bytes are joins over few rows, the longer ones are computed within a
bucket, which holds all windows they need. Then each run is answered with the values of its own
keys, and the answers meet the texts of their block. Keys, counts and values travel as compressed
runs. Nothing of corpus size is broadcast; a task holds the values of one block or the distinct
keys of one bucket, and buckets grow in number with the corpus.

A text is its bytes with A-Z lower-cased, after `ORDER` start bytes and before one end byte. The
score is the log10 probability of the whole; the base score is that of add-one word counts.

Defined results: null texts count as empty and consist of the end alone; ties do not arise; equal
texts score alike; without training texts every byte has probability 1/256; an empty table gives
an empty result; repeated rows are counted and scored each; a text longer than a block is a block.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import groupby
from operator import itemgetter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..session import materialize
from .common import id_remainder, map_columns, table, whole_text

ORDER, SHARED = 5, 3
BLOCK_CHARS = 12_000_000
BUCKET_CHARS = 4_000_000  # text for each bucket of windows and of words
START, END = 0xFE, 0xFF  # bytes that UTF-8 never holds
HELD_OUT, HELD_OUT_IS = 7, 2
WORDS, GRAMS, TEXTS = range(3)  # kinds of runs, in the order in which a block is read
PACKED = "kind int, block long, bucket int, keys binary, numbers binary"
SUMS = "kind int, bucket int, keys binary, numbers binary, total long, seen long"
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long"
SLICE_WINDOWS, SPREAD = 1 << 20, 0x9E3779B1
PARTS = 16  # of a block's windows, merged one after another; no more than there are buckets
TEXT = pa.schema([("doc_id", pa.int64()), ("train", pa.bool_()), ("text", pa.binary())])


# ---- compressed runs
def packed(numbers: np.ndarray) -> bytes:
    """Numbers of eight bytes, compressed byte plane by byte plane."""
    planes = np.ascontiguousarray(numbers.view(np.uint8).reshape(len(numbers), 8).T)
    return len(numbers).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes, kind: type = np.int64) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], 8 * n, "zstd"), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view(kind).reshape(n)


def packed_keys(kind: int, keys) -> bytes:
    """Sorted windows as differences, or words in any order with spaces between, as they hold none."""
    if kind == GRAMS:
        return packed(np.diff(keys, prepend=0))
    data = b" ".join(keys)
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def unpacked_keys(kind: int, data: bytes):
    if kind == GRAMS:
        return np.cumsum(unpacked(data))
    return bytes(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd")).split(b" ")


def packed_texts(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, TEXT, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def give_back() -> None:
    """Returns memory that Arrow keeps for later; the worker lives on when its task has ended."""
    pa.default_memory_pool().release_unused()


# ---- blocks
def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Windows of ORDER + 1 bytes ending at each byte and at the end of each text, as numbers, and
    the position of each text's first one."""
    pad, sizes = bytes([START]) * ORDER, np.array([len(x) + 1 for x in texts], np.int64)
    data = np.frombuffer(b"".join(pad + x + b"\xff" for x in texts), np.uint8)
    found = np.zeros(len(data) - ORDER, np.int64)
    for k in range(ORDER + 1):
        found <<= 8
        found |= data[k:len(data) - ORDER + k]
    return found[data[ORDER:] != START], np.cumsum(sizes) - sizes


def slices(rows: pa.Table) -> Iterator[pa.Table]:
    """Tables of consecutive rows with about SLICE_WINDOWS bytes of text each."""
    number = np.cumsum(pc.binary_length(rows["text"]).to_numpy()) // SLICE_WINDOWS
    for part in np.split(np.arange(len(number)), np.flatnonzero(np.diff(number)) + 1):
        if len(part):
            yield rows.slice(part[0], len(part))


def merged(grams: Sequence[np.ndarray], counts: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows in order and the sums of their counts."""
    every = np.concatenate([np.empty(0, np.int64), *grams])
    order = np.argsort(every, kind="stable")
    every, numbers = every[order], np.concatenate([np.empty(0, np.int64), *counts])[order]
    starts = np.flatnonzero(np.diff(every, prepend=-1))
    return every[starts], np.add.reduceat(numbers, starts) if len(starts) else numbers


def gram_buckets(grams: np.ndarray, buckets: int) -> np.ndarray:
    shared = grams >> 8 & (1 << 8 * SHARED) - 1
    return (shared * SPREAD >> 12) % buckets


def gram_bucket(gram: Column, buckets: int) -> Column:
    """The same of a column."""
    shared = F.shiftright(gram, 8).bitwiseAND((1 << 8 * SHARED) - 1)
    return (F.shiftright(shared * SPREAD, 12) % buckets).cast("int")


def learned_counts(found: np.ndarray, learned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows in order and how many of each are learned; `found` is overwritten."""
    found <<= 1
    found |= learned
    found.sort()
    starts = np.flatnonzero(np.diff(found >> 1, prepend=-1))
    return found[starts] >> 1, np.add.reduceat(found & 1, starts).astype(np.int32)


class Block:
    """What a block needs and counts: its distinct windows and words (the end token as the empty
    word) with their training occurrences. The windows of each slice are dealt to PARTS ranges of
    buckets, so that those of the whole block are merged part by part."""

    def __init__(self, buckets: int) -> None:
        self.size, self.buckets, self.grams, self.words, self.other = 0, buckets, [], Counter(), set()

    def add(self, rows: pa.Table) -> None:
        texts, train = [x.lower() for x in rows["text"].to_pylist()], rows["train"].to_numpy()
        sizes = [len(x) + 1 for x in texts]
        keys, times = learned_counts(windows(texts)[0], np.repeat(train, sizes))
        part = (gram_buckets(keys, self.buckets) * PARTS // self.buckets).astype(np.uint8)
        order = np.argsort(part, kind="stable")
        self.grams.append((keys[order], times[order], np.searchsorted(part[order], np.arange(PARTS + 1))))
        for text, learned in zip(texts, train.tolist()):
            self.words.update(text.split()) if learned else self.other.update(text.split())
        self.words[b""] += int(train.sum())
        self.size += sum(sizes)

    def runs(self) -> Iterator[tuple]:
        """kind, bucket, keys and numbers, packed."""
        for part in range(PARTS):
            held = [(keys[at[part]:at[part + 1]], times[at[part]:at[part + 1]]) for keys, times, at in self.grams]
            grams, counts = merged(*zip(*held))
            place = gram_buckets(grams, self.buckets)
            order = np.argsort(place, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(place[order])) + 1):
                if len(at):
                    yield GRAMS, int(place[at[0]]), packed_keys(GRAMS, grams[at]), packed(counts[at])
        for word in self.other:
            self.words.setdefault(word, 0)
        dealt: dict[int, list[bytes]] = {}
        for word in self.words:
            dealt.setdefault(crc32(word) % self.buckets, []).append(word)
        for bucket, words in dealt.items():
            yield WORDS, bucket, packed_keys(WORDS, words), packed(np.fromiter(map(self.words.__getitem__, words), np.int64, len(words)))


def packed_blocks(docs: DataFrame, buckets: int, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The texts of `docs` in blocks, and the runs of each block: rows of PACKED. Those of kind
    TEXTS hold texts in `numbers`."""
    def work(batches):
        from pyspark import TaskContext

        number, block = TaskContext.get().partitionId() << 32, Block(buckets)

        def finish():
            found = list(zip(*block.runs()))
            yield [found[0], np.full(len(found[0]), number), *found[1:]]
            give_back()

        for batch in batches:
            for rows in slices(pa.Table.from_batches([batch]).cast(TEXT)):
                block.add(rows)
                yield [[TEXTS], [number], [None], [None], [packed_texts(rows)]]
                if block.size >= block_chars:
                    yield from finish()
                    number, block = number + 1, Block(buckets)
        if block.size:
            yield from finish()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (id_remainder(HELD_OUT) != HELD_OUT_IS).alias("train"),
                       whole_text().cast("binary").alias("text"))
    return map_columns(rows, PACKED, work)


def rows_of(batches, columns: tuple[str, ...]) -> Iterator[tuple]:
    """Rows one at a time: runs are long, and a batch of them, copied, as long again."""
    for batch in batches:
        held = [batch[c] for c in columns]
        for k in range(batch.num_rows):
            yield tuple(column[k].as_py() for column in held)


def by_bucket(batches, columns: tuple[str, ...]) -> Iterator[tuple]:
    """kind, bucket and an iterator over the other columns, for rows ordered by kind and bucket."""
    for (kind, bucket), own in groupby(rows_of(batches, ("kind", "bucket", *columns)), itemgetter(0, 1)):
        yield kind, bucket, (row[2:] for row in own)


def run_sums(runs: DataFrame) -> DataFrame:
    """SUMS: one row for each kind and bucket, its distinct keys in order, their counts over all
    blocks, the sum of these and the number of keys that training texts hold."""
    def work(batches):
        for kind, bucket, own in by_bucket(batches, ("keys", "numbers")):
            if kind == WORDS:
                words: Counter = Counter()
                for keys, numbers in own:
                    for word, n in zip(unpacked_keys(WORDS, keys), unpacked(numbers).tolist()):
                        words[word] += n
                every = sorted(words)
                counts = np.array([words[w] for w in every], np.int64)
            else:
                held, waiting = [[], []], 0
                for keys, numbers in own:
                    for part, data in zip(held, (unpacked_keys(GRAMS, keys), unpacked(numbers))):
                        part.append(data)
                    waiting += len(held[0][-1])
                    if waiting > max(1 << 20, 2 * len(held[0][0])):  # memory follows the distinct windows
                        held, waiting = [[x] for x in merged(*held)], 0
                every, counts = merged(*held)
            yield [[kind], [bucket], [packed_keys(kind, every)], [packed(counts)], [int(counts.sum())], [int((counts > 0).sum())]]

    dealt = runs.select("kind", "bucket", "keys", "numbers").repartition("kind", "bucket").sortWithinPartitions("kind", "bucket")
    return map_columns(dealt, SUMS, work)


# ---- trie
def trie_level(counts: DataFrame, size: int, shorter: DataFrame | None) -> DataFrame:
    """Windows of `size` bytes: w, c, n, d of their context, and two probabilities of the last
    byte: `fresh` with no byte excluded, `after` having escaped from this context.

    `seen_shorter` sums the counts, one level below, of the bytes seen in this context: what an
    escape excludes there.
    """
    rows = counts.groupBy(F.col("w").bitwiseAND((1 << 8 * size) - 1).alias("w")).agg(F.sum("c").alias("c"))
    if shorter is None:
        rows = rows.withColumns({"c_s": F.lit(0).cast("long"), "n_s": F.lit(0).cast("long"), "d_s": F.lit(256).cast("long"),
                                 "after_s": F.lit(0.0), "fresh_s": F.lit(1 / 256)})
    else:
        below = shorter.select(F.col("w").alias("_s"), *(F.col(c).alias(f"{c}_s") for c in ("c", "n", "d", "after", "fresh")))
        rows = rows.withColumn("_s", F.col("w").bitwiseAND((1 << 8 * (size - 1)) - 1)).join(below, "_s").drop("_s")
    context = W.partitionBy(F.shiftright("w", 8))
    rows = rows.withColumns({"n": F.sum("c").over(context), "d": F.sum((F.col("c") > 0).cast("long")).over(context),
                             "seen_shorter": F.sum(F.when(F.col("c") > 0, F.col("c_s")).otherwise(0)).over(context)})
    left_n, left_d = F.col("n_s") - F.col("seen_shorter"), F.col("d_s") - F.col("d")
    if shorter is None:  # the 256 - d byte values never seen
        after: Column = 1 / F.greatest(left_d, F.lit(1))
    else:
        after = (F.when(left_n <= 0, F.col("after_s")).when(F.col("c_s") > 0, (2 * F.col("c_s") - 1) / (2 * left_n))
                 .otherwise(left_d / (2 * left_n) * F.col("after_s")))
    rows = rows.withColumn("after", after)
    fresh = (F.when(F.col("n") == 0, F.col("fresh_s")).when(F.col("c") > 0, (2 * F.col("c") - 1) / (2 * F.col("n")))
             .otherwise(F.col("d") / (2 * F.col("n")) * F.col("after")))
    return rows.select("w", "c", "n", "d", "after", fresh.alias("fresh"))


def next_level(windows_: np.ndarray, counts: np.ndarray, size: int, below: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """`trie_level` within a bucket, for sorted windows of `size` bytes; `below` and the result are
    w, c, n, d, after, fresh."""
    at = np.searchsorted(below[0], windows_ & (1 << 8 * (size - 1)) - 1)
    c_s, n_s, d_s, after_s, fresh_s = (x[at] for x in below[1:])
    context = windows_ >> 8
    starts = np.flatnonzero(np.diff(context, prepend=-1))
    times = np.diff(np.append(starts, len(windows_)))

    def over_context(values: np.ndarray) -> np.ndarray:
        return np.repeat(np.add.reduceat(values, starts), times)

    seen = counts > 0
    n, d, excluded = over_context(counts), over_context(seen.astype(np.int64)), over_context(np.where(seen, c_s, 0))
    left_n, left_d = n_s - excluded, d_s - d
    whole = 2.0 * np.maximum(left_n, 1)
    after = np.where(left_n <= 0, after_s, np.where(c_s > 0, (2 * c_s - 1) / whole, left_d / whole * after_s))
    twice = 2.0 * np.maximum(n, 1)
    fresh = np.where(n == 0, fresh_s, np.where(seen, (2 * counts - 1) / twice, d / twice * after))
    return windows_, counts, n, d, after, fresh


def gram_values(sums: DataFrame, buckets: int) -> DataFrame:
    """kind, bucket, keys, numbers: log10 probabilities of the last byte of all windows."""
    size = SHARED + 1

    def suffixes(batches):
        for batch in batches:
            for keys, numbers in zip(batch["keys"].to_pylist(), batch["numbers"].to_pylist()):
                yield list(merged([unpacked_keys(GRAMS, keys) & (1 << 8 * size) - 1], [unpacked(numbers)]))

    own = sums.where(F.col("kind") == GRAMS)
    counts = materialize(map_columns(own.select("keys", "numbers"), "w long, c long", suffixes), "ppm-suffixes")
    level = None
    for n in range(1, size + 1):
        level = trie_level(counts, n, level)
        level = level if n == size else materialize(level, "ppm-level")  # the last one is read once
    names = ("w", "c", "n", "d", "after", "fresh")
    of_bucket = level.groupBy(gram_bucket(F.col("w"), buckets).alias("bucket")).agg(F.sort_array(F.collect_list(F.struct(*names))).alias("below"))

    def work(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                keys, numbers = unpacked_keys(GRAMS, batch["keys"][k].as_py()), unpacked(batch["numbers"][k].as_py())
                rows = batch["below"][k].values
                found = tuple(rows.field(c).to_numpy(zero_copy_only=False) for c in names)
                for longer in range(size + 1, ORDER + 2):
                    found = next_level(*merged([keys & (1 << 8 * longer) - 1], [numbers]), longer, found)
                yield [[GRAMS], [batch["bucket"][k].as_py()], [batch["keys"][k].as_py()], [packed(np.log10(found[-1]))]]

    return map_columns(own.join(of_bucket, "bucket").select("bucket", "keys", "numbers", "below"), "kind int, bucket int, keys binary, numbers binary", work)


def answers(runs: DataFrame, values: DataFrame) -> DataFrame:
    """PACKED: each run with the values of its keys for numbers."""
    def work(batches):
        for kind, bucket, own in by_bucket(batches, ("block", "keys", "numbers")):
            _, keys, numbers = next(own)  # the bucket's values, which have no block, come first
            every = unpacked_keys(kind, keys)
            if kind == WORDS:
                count_of = dict(zip(every, unpacked(numbers).tolist()))
            else:
                known = unpacked(numbers, np.float64)
            for block, keys, _ in own:
                asked = unpacked_keys(kind, keys)
                if kind == WORDS:
                    found = np.fromiter(map(count_of.__getitem__, asked), np.int64, len(asked))
                else:
                    found = known[np.searchsorted(every, asked)]
                yield [[kind], [block], [bucket], [keys], [packed(found)]]

    rows = runs.unionByName(values.withColumn("block", F.lit(None).cast("long")))
    dealt = rows.repartition("kind", "bucket").sortWithinPartitions("kind", "bucket", F.col("block").asc_nulls_first())
    return map_columns(dealt, PACKED, work)


class Index:
    """Values by key. Keys are ordered by a hash whose leading bits tell where to begin, so that a
    search takes a step or two, not the twenty of a binary search."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = len(keys).bit_length()
        self.shift = np.uint64(64 - bits)
        slots = self.slots(keys)
        order = np.argsort(slots, kind="stable")
        self.keys, self.values = keys[order], values[order]
        self.starts = np.searchsorted(slots[order], np.arange(1 << bits, dtype=np.uint64))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift

    def __getitem__(self, wanted: np.ndarray) -> np.ndarray:
        """The values of keys that are all held."""
        at = self.starts[self.slots(wanted)]
        wrong = np.flatnonzero(self.keys[at] != wanted)
        while len(wrong):
            at[wrong] += 1
            wrong = wrong[self.keys[at[wrong]] != wanted[wrong]]
        return self.values[at]


def score_texts(rows: pa.Table, values: Index, count_of: dict[bytes, int], total: int, distinct: int) -> list:
    texts = [x.lower() for x in rows["text"].to_pylist()]
    found, starts = windows(texts)
    scores = np.add.reduceat(values[found], starts)
    base, n_tokens, n_known = [], [], []
    for text in texts:
        words = text.split()
        words.append(b"")
        c = np.fromiter(map(count_of.__getitem__, words), np.float64, len(words))
        n_tokens.append(len(words))
        n_known.append(int(np.count_nonzero(c)))
        base.append(float(np.log10((c + 1) / (total + distinct + 1)).sum()))
    return [rows["doc_id"].combine_chunks(), pc.invert(rows["train"]).combine_chunks(), n_tokens, n_known, [total] * len(texts), base, scores, [len(x) for x in texts]]


def score_stream(batches, total: int, distinct: int):
    """Scores of the texts in rows ordered by block and kind: a block's words and windows come
    before its texts and are kept until the next block."""
    for _, own in groupby(rows_of(batches, ("block", "kind", "keys", "numbers")), itemgetter(0)):
        count_of, keys, values, value_of = {}, [], [], None
        for _, kind, asked, numbers in own:
            if kind == WORDS:
                count_of.update(zip(unpacked_keys(WORDS, asked), unpacked(numbers).tolist()))
            elif kind == GRAMS:
                keys.append(unpacked_keys(GRAMS, asked))
                values.append(unpacked(numbers, np.float64))
            else:
                if value_of is None:
                    value_of = Index(np.concatenate(keys), np.concatenate(values))
                yield score_texts(pa.ipc.open_stream(numbers).read_all(), value_of, count_of, total, distinct)
        give_back()


def score(docs: DataFrame, block_chars: int = BLOCK_CHARS, bucket_chars: int = BUCKET_CHARS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes of every text."""
    chars = docs.agg(F.sum(F.length(whole_text()) + 1)).first()[0] or 0
    buckets = max(16, -(-chars // bucket_chars))
    blocks = materialize(packed_blocks(docs, buckets, block_chars), "ppm-blocks")
    runs = blocks.where(F.col("kind") != TEXTS)
    sums = materialize(run_sums(runs), "ppm-sums")
    total, distinct = sums.where(F.col("kind") == WORDS).agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("seen"), F.lit(0))).first()
    values = sums.where(F.col("kind") == WORDS).select("kind", "bucket", "keys", "numbers").unionByName(gram_values(sums, buckets))
    rows = answers(runs, values).unionByName(blocks.where(F.col("kind") == TEXTS))
    ordered = rows.select("block", "kind", "keys", "numbers").repartition("block").sortWithinPartitions("block", "kind")
    return map_columns(ordered, RESULT, lambda batches: score_stream(batches, total, distinct))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"))
