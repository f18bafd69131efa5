"""Document fingerprints of closed syncmers; DataFrame operations only.

A text's words are hashed; `K` consecutive words are a k-mer, `S` of them an inner s-mer. A k-mer
is an anchor if its least s-mer is its first or last one, which depends on its own words alone:
an edit elsewhere moves no anchor. A fingerprint is all distinct anchor hashes of the text in
order, so equal texts have equal ones, and the likeness of two texts is Dice's of the whole sets.

Common anchors are also matched by position: the n-th occurrence of a hash in one text goes with
the n-th in the other. The commonest difference of their positions is the `shift` (of equally
common ones the least in size, then the negative one), and `aligned` of the `matched` pairs have it.

Words are hashed once, windows are read by position, and the anchors of two texts are matched by
one sort of them all, if they have any in common.

The edited text takes its second half from the next document by descending id. Documents are cut
into id ranges, each ordered on its own, and ranges overlap in the rows of one id, so no task holds
the whole order.

Defined results: null texts count as empty; texts without words have an empty fingerprint, two
of them are alike (1); texts of fewer than `K` words have one anchor, of all their words; rows with
equal ids follow each other by digest of their text; the one row of a table is its own next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import WHITE, let, table, whole_text

K, S = 4, 2
RANGE_DOCS, RANGES = 512, 1 << 16  # documents in an id range, about, up to so many ranges; then the ranges grow
SORT_IDS, SORT_PARTS = 1 << 16, 512  # ids that a task sorts, about, up to so many tasks; then they sort more


def word_hashes(text: Column) -> Column:
    words = F.filter(F.split(text, WHITE), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def anchors(hashes: Column, k: int = K, s: int = S) -> Column:
    """(position, hash) of each anchor of an array of word hashes."""
    def windows(words: Column, size: int) -> Column:
        return F.when(F.size(words) >= size, F.sequence(F.lit(0), F.size(words) - size)).otherwise(F.array().cast("array<int>"))

    def chosen(words: Column, inner: Column) -> Column:
        def is_anchor(i: Column) -> Column:
            edge = F.least(F.get(inner, i), F.get(inner, i + (k - s)))
            return F.forall(F.sequence(F.lit(1), F.lit(k - s - 1)), lambda j: edge <= F.get(inner, i + j)) if k - s > 2 else edge <= F.get(inner, i + 1)

        return F.transform(F.filter(windows(words, k), is_anchor), lambda i: F.struct(
            i.alias("position"), F.xxhash64(*(F.get(words, i + j) for j in range(k))).alias("hash")))

    def few(words: Column) -> Column:  # one anchor of all words, or none
        return F.transform(F.slice(words, 1, 1), lambda w: F.struct(F.lit(0).alias("position"), F.xxhash64(words).alias("hash")))

    return let(hashes, lambda h: F.when(F.size(h) < k, few(h)).otherwise(let(
        F.transform(windows(h, s), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(s)))), lambda inner: chosen(h, inner))))


def text_anchors(text: Column) -> Column:
    return anchors(word_hashes(text))


def distinct_hashes(found: Column) -> Column:
    """The hashes of all anchors, each once, sorted."""
    return F.sort_array(F.array_distinct(F.transform(found, lambda a: a["hash"])))


def written(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Dice's likeness of two sets of hashes."""
    both = 2 * F.size(F.array_intersect(a, b)) / F.greatest(F.size(a) + F.size(b), F.lit(1))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both)


def runs(sorted_: Column, key: Callable[[Column], Column]) -> Column:
    """(start, length) of the runs of equal keys in a sorted array."""
    n = F.size(sorted_)
    indices = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(indices, lambda i: (i == 0) | (key(F.get(sorted_, i - 1)) != key(F.get(sorted_, i))))
    return let(starts, lambda at: F.transform(at, lambda i, j: F.struct(
        i.alias("start"), (F.coalesce(F.get(at, j + 1), n) - i).alias("length"))))


def matches(a: Column, b: Column) -> Column:
    """(position, other) of the anchors that two texts have in common, ordered by hash. All anchors
    are sorted by hash, then text, then position; a run of one hash holds its occurrences in the
    first text, then those in the second."""
    def entries(found: Column, side: int) -> Column:
        return F.transform(found, lambda x: F.struct(x["hash"].alias("hash"), F.lit(side).alias("side"), x["position"].alias("position")))

    def pairs(s: Column) -> Column:
        def of_run(r: Column) -> Column:
            places = F.sequence(r["start"], r["start"] + r["length"] - 1)
            mine = F.size(F.filter(places, lambda i: F.get(s, i)["side"] == 0))
            return let(mine, lambda n: F.transform(F.sequence(F.lit(0), F.least(n, r["length"] - n) - 1), lambda k: F.struct(
                F.get(s, r["start"] + k)["position"].alias("position"), F.get(s, r["start"] + n + k)["position"].alias("other"))))

        both = F.filter(runs(s, lambda x: x["hash"]), lambda r: (F.get(s, r["start"])["side"] == 0) & (F.get(s, r["start"] + r["length"] - 1)["side"] == 1))
        return F.flatten(F.transform(both, of_run))

    nothing = F.array().cast("array<struct<position:int,other:int>>")
    return F.when(F.arrays_overlap(F.transform(a, lambda x: x["hash"]), F.transform(b, lambda x: x["hash"])),
                  let(F.sort_array(F.concat(entries(a, 0), entries(b, 1))), pairs)).otherwise(nothing)


def alignment(pairs: Column) -> Column:
    """matched, shift and aligned of matched positions; shift is null without any."""
    def best(shifts: Column) -> Column:
        found = F.array_max(F.transform(runs(shifts, lambda x: x), lambda r: F.struct(
            r["length"].alias("n"), (-F.abs(F.get(shifts, r["start"]))).alias("near"), (-F.get(shifts, r["start"])).alias("back"))))
        return F.struct(F.size(shifts).alias("matched"), (-found["back"]).alias("shift"), F.coalesce(found["n"], F.lit(0)).alias("aligned"))

    return let(F.sort_array(F.transform(pairs, lambda p: p["other"] - p["position"])), best)


def fingerprint(docs: DataFrame) -> DataFrame:
    """`docs` with n_chars, anchors and fingerprint of the whole text."""
    docs = docs.withColumn("anchors", text_anchors(whole_text()))
    return docs.withColumns({"n_chars": F.char_length(whole_text()).cast("long"), "fingerprint": written(distinct_hashes(F.col("anchors")))})


def range_starts(ids: DataFrame, range_docs: int) -> list[int]:
    """Ids that occur in `ids` (doc_id), the least one first, with `range_docs` rows from one to the
    next, fewer where a sorted part ends. All ids are sorted, on executors; the driver gets the
    starts alone, RANGES and one for each part at most."""
    ids = ids.where("doc_id IS NOT NULL")
    n = ids.count()
    if not n:
        return []
    range_docs = max(range_docs, -(-n // RANGES))
    parts = ids.repartitionByRange(min(SORT_PARTS, -(-n // SORT_IDS)), "doc_id").sortWithinPartitions("doc_id")
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # in its part, from 0
    found = parts.select("doc_id", place.alias("_at")).where(F.col("_at") % range_docs == 0).select("doc_id").collect()
    return sorted({r.doc_id for r in found})


def constant(numbers: list[int]) -> Column:
    """An array of long integers, folded into the plan as one value (a lambda would not be)."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<bigint>") if numbers else F.array().cast("array<bigint>")


def range_of(id_: Column, starts: list[int]) -> Column:
    """How many of the sorted `starts` are not above the id, by halving; 0 for null."""
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(starts).bit_length()))))
    all_ = constant(starts)
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(all_, at + step - 1) <= id_, at + step).otherwise(at)) if starts else F.lit(0)


def with_next(docs: DataFrame, range_docs: int = RANGE_DOCS) -> DataFrame:
    """`docs` (doc_id, text) with the text of the next document.

    Rows with the first id of a range are its last in falling order: what follows them lies in the
    range below, so they are dealt there, and a copy stays behind as the next of the row above.
    Null ids follow the least id, in the lowest range; a copy of the first row of all ends it.
    """
    docs = docs.select("doc_id", whole_text().alias("text")).withColumn("_tie", F.md5("text"))
    starts = range_starts(docs.select("doc_id"), range_docs)
    at = range_of(F.col("doc_id"), starts)
    rows = docs.withColumn("_range", at)
    is_start = F.coalesce(F.get(constant(starts), F.col("_range") - 1) == F.col("doc_id"), F.lit(False))
    place = F.when(is_start, F.array(F.struct((F.col("_range") - 1).alias("range"), F.lit(0).alias("copy")), F.struct(F.col("_range").alias("range"), F.lit(1).alias("copy")))
                   ).otherwise(F.array(F.struct(F.col("_range").alias("range"), F.lit(0).alias("copy"))))
    rows = rows.withColumn("_place", F.explode(place)).select("doc_id", "text", "_tie", F.col("_place.range").alias("_range"), F.col("_place.copy").alias("_copy"))
    top = docs.agg(F.max("doc_id")).first()[0]
    first = docs.where(F.col("doc_id").eqNullSafe(F.lit(top).cast("long")))
    tie = first.agg(F.min("_tie")).first()[0]
    first = first.where(F.col("_tie") == F.lit(tie).cast("string")).limit(1).select("doc_id", "text", "_tie", F.lit(0).alias("_range"), F.lit(2).alias("_copy"))
    within = W.partitionBy("_range").orderBy(F.col("_copy") == 2, F.col("doc_id").desc_nulls_last(), "_tie")
    found = rows.unionByName(first).withColumn("next_text", F.lead("text").over(within))
    return found.where("_copy = 0").select("doc_id", "text", "next_text")


def edited(text: Column, following: Column) -> Column:
    """`text` with its last floor(n/2) code points replaced by the first as many of `following`."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substr(text, F.lit(1), F.char_length(text) - half), F.substr(following, F.lit(1), half))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_next(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    rows = rows.withColumn("edited", edited(F.col("text"), F.col("next_text")))
    texts = {"own": "text", "edited": "edited", "next": "next_text"}
    rows = rows.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
                       *(text_anchors(F.col(c)).alias(f"{k}_anchors") for k, c in texts.items()))
    rows = rows.withColumns({f"{k}_hashes": distinct_hashes(F.col(f"{k}_anchors")) for k in texts})
    rows = rows.withColumns({f"{k}_match": alignment(matches(F.col("own_anchors"), F.col(f"{k}_anchors"))) for k in ("edited", "next")})
    return rows.select("doc_id", "n_chars", "edited_sha256", written(F.col("own_hashes")).alias("fingerprint"),
                       written(F.col("edited_hashes")).alias("edited_fingerprint"),
                       likeness(F.col("own_hashes"), F.col("edited_hashes")).alias("near_edited"),
                       likeness(F.col("own_hashes"), F.col("next_hashes")).alias("near_next"),
                       *(F.col(f"{k}_match")[c].alias(f"{c}_{k}") for k in ("edited", "next") for c in ("matched", "shift", "aligned")))
