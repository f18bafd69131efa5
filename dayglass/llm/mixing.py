"""Mixing sources to target weights by Pfair scheduling; DataFrame operations only.

Each source is cut into blocks of `block_docs` documents, in an order drawn by hash. Block i of a
source with weight w (of 1 in all) is released at slot floor((i-1)/w) and due by slot ceil(i/w);
the earliest due among the released blocks takes each slot. After t slots a source has had t·w
blocks, off by less than one, up to the slot where the first source runs dry. Then
no order has the target weights any more, and the blocks left follow by their due slots. No
document is dropped or repeated; `stop="first"` ends the mixture where the first source runs dry.

The slots are cut into ranges of `RANGE`, each folded as a row of its own from the state at its
first slot. That state needs no other range: by a border all blocks due are done, and each source
has one more block at most that may be. Of these a block is done if, with all blocks of earlier due
slots, it fits into the slots from its release on; so they are gone through by due slot, and counts
of the blocks released since each slot tell whether one more fits. This looks back as far as the
longest time from release to due slot, 1/w of the least weight. The ranges together are the very
order that one fold over all slots gives. There is no limit to the number of sources or of slots.

With `parts`, weights are rounded to integer shares s of `parts`, and one period of as many slots
repeats, so that only one period is folded. The deviation is then below one block from s/parts,
not from the weight: the rounding adds up to t/parts blocks after t slots (more where sources below
one part are raised to one), a source that has run dry leaves its slots empty, and more than
`parts` sources are an error. The registered query uses the exact weights.

A hot source is cut by hash into `buckets` ranges, which are numbered apart and then offset by
the counts of the ranges before, so no source is ordered in one task.

Defined results: null sources are one source of their own; sources without a target get none
of the mixture unless `other` gives them one or `weights` is None (weights by the square root of the sources' sizes);
null ids and ties are ordered by id and text digest, so repeated rows keep all copies; an empty
table gives an empty result; columns named like the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..session import materialize
from .common import let, table

BLOCK_DOCS, BUCKETS = 32, 4096
RANGE = 4096  # slots of a range, folded by one task
FOLD = 512  # slots that are appended to one array
KEY, RANK = "_source", "_hash"
HELPERS = (KEY, RANK, "_bucket", "_within", "_before", "_place")


def draw(docs: DataFrame) -> DataFrame:
    """Source key and the hash that orders and cuts a source."""
    return docs.withColumns({
        KEY: F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")),
        RANK: F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))})


def source_sizes(drawn: DataFrame) -> DataFrame:
    return drawn.groupBy(KEY).agg(F.count("*").alias("_n"))


def weighed(sizes: DataFrame, weights: dict[str | None, float] | None, other: float | None) -> DataFrame:
    """`sizes` of the sources that have a target, with _w; `other` is the weight of unnamed ones."""
    if weights is None:
        return sizes.withColumn("_w", F.sqrt("_n"))
    pairs = [F.struct(F.lit("" if s is None else f"={s}").alias("k"), F.lit(float(w)).alias("w")) for s, w in weights.items()]
    found = F.filter(F.array(*pairs), lambda p: p["k"] == F.col(KEY)) if pairs else None
    unnamed = F.lit(other).cast("double")
    return sizes.withColumn("_w", unnamed if found is None else F.coalesce(F.get(found, F.lit(0))["w"], unnamed)).where("_w > 0")


def shares(sizes: DataFrame, parts: int) -> DataFrame:
    """One row of all sources: entries = array of (key, share), the shares adding up to `parts`.

    By largest remainder, ties by name; where a source would get less than one part, each gets one
    first and the rest is shared out.
    """
    rows = sizes.agg(F.sort_array(F.collect_list(F.struct(F.col(KEY).alias("k"), F.col("_w").alias("w")))).alias("s"))
    fits = F.when(F.size("s") <= parts, F.col("s")).otherwise(F.raise_error(F.lit(f"more than {parts} sources: raise parts")))
    rows = rows.select(fits.alias("s"))
    total = F.aggregate("s", F.lit(0.0), lambda a, x: a + x["w"])
    scarce = F.exists("s", lambda x: x["w"] * parts < total).cast("int")  # a source below one part: one for each comes first
    rows = rows.select("s", total.alias("t"), scarce.alias("g"))
    left = F.lit(parts) - F.col("g") * F.size("s")
    rows = rows.select("g", left.alias("left"), F.transform("s", lambda x: F.struct(
        x["k"].alias("k"), F.round(x["w"] / F.col("t") * left, 9).alias("e"))).alias("s"))
    floors = F.aggregate("s", F.lit(0), lambda a, x: a + F.floor(x["e"]).cast("int"))
    order = F.transform(F.sort_array(F.transform("s", lambda x: F.struct((F.floor(x["e"]) - x["e"]).alias("r"), x["k"].alias("k")))), lambda x: x["k"])
    rows = rows.select("g", "left", "s", floors.alias("f"), order.alias("o"))
    return rows.select(F.transform("s", lambda x: F.struct(x["k"].alias("key"), (
        F.col("g") + F.floor(x["e"]).cast("int") + (F.array_position("o", x["k"]) <= F.col("left") - F.col("f")).cast("int")).alias("share"))).alias("entries"))


def one_period(entries: DataFrame, parts: int) -> DataFrame:
    """Rows (key, share, turn, at): the slot in the period of each source's turn-th block.

    The fold keeps how many blocks each source has had; of the sources whose next block is
    released, the one with the earliest deadline (ties by name) takes the slot.
    """
    def next_source(had: Column, slot: Column) -> Column:
        due = F.transform(F.sequence(F.lit(0), F.size("entries") - 1), lambda j: F.struct(
            F.ceil((F.get(had, j) + 1) * parts / F.get("entries", j)["share"]).alias("due"), j.alias("j"),
            (F.floor(F.get(had, j) * parts / F.get("entries", j)["share"]) <= slot).alias("free")))
        return F.array_min(F.filter(due, lambda x: x["free"]))["j"]

    def step(state: Column, slot: Column) -> Column:
        return let(next_source(state["had"], slot), lambda chosen: F.struct(
            F.transform(state["had"], lambda n, j: F.when(j == chosen, n + 1).otherwise(n)).alias("had"),
            F.concat(state["order"], F.array(chosen)).alias("order")))

    start = F.struct(F.transform("entries", lambda e: F.lit(0)).alias("had"), F.array().cast("array<int>").alias("order"))
    filled = entries.where(F.size("entries") > 0)
    period = filled.select("entries", F.aggregate(F.sequence(F.lit(0), F.lit(parts - 1)), start, step, lambda s: s["order"]).alias("order"))
    taken = period.select("entries", F.posexplode("order").alias("at", "j"))
    turn = F.row_number().over(W.partitionBy("j").orderBy("at")) - 1
    return taken.select(F.get("entries", F.col("j"))["key"].alias(KEY), F.get("entries", F.col("j"))["share"].alias("_share"), turn.alias("_turn"), F.col("at").alias("_at"))


def whole(x: Column, up: bool = False) -> Column:
    """x rounded down or up, where a rounding error next to a whole number counts as none."""
    return (F.ceil if up else F.floor)(F.round(x, 9))


def border_state(border: Column) -> Column:
    """How many blocks each source of `s` has had when earliest-due-first has filled the slots
    below `border`."""
    def cell(x: Column, j: Column) -> Column:
        low = whole(border * x["w"])  # these are due
        return F.struct(low.alias("low"), x["w"].alias("w"), whole((low + 1) / x["w"], up=True).alias("due"), j.alias("j"),
                        whole(low / x["w"]).alias("release"), (low < F.round(border * x["w"], 9)).alias("next"))

    def with_room(cells: Column) -> Column:
        maybe = F.array_sort(F.transform(F.filter(cells, lambda c: c["next"]), lambda c: F.struct(c["due"], c["j"], c["release"])))
        back = F.coalesce(F.array_min(F.transform(maybe, lambda c: c["release"])), border - 1)

        all_room = border - F.aggregate(cells, F.lit(0).cast("long"), lambda n, c: n + c["low"])

        def room(since: Column) -> Column:  # slots from `since` on, less the due blocks released from then on
            return border - since - F.aggregate(cells, F.lit(0).cast("long"), lambda n, c: n + F.greatest(c["low"] - whole(since * c["w"], up=True), F.lit(0)))

        def admit(state: Column, c: Column) -> Column:
            last = (c["release"] - back).cast("int")  # a block takes room since all slots up to its release
            fits = (F.size(state["done"]) < all_room) & (F.array_min(F.slice(state["rooms"], F.lit(1), last + 1)) > 0)
            return F.when(fits, F.struct(F.transform(state["rooms"], lambda n, i: F.when(i <= last, n - 1).otherwise(n)).alias("rooms"),
                                         F.concat(state["done"], F.array(c["j"])).alias("done"))).otherwise(state)

        start = F.struct(F.transform(F.sequence(back, border - 1), room).alias("rooms"), F.array().cast("array<int>").alias("done"))
        done = F.aggregate(maybe, start, admit, lambda state: state["done"])
        return let(done, lambda found: F.transform(cells, lambda c: c["low"] + F.array_contains(found, c["j"]).cast("long")))

    return F.when(border > 0, let(F.transform("s", cell), with_room)).otherwise(F.transform("s", lambda x: F.lit(0).cast("long")))


def range_orders(rows: DataFrame, slots: int) -> DataFrame:
    """Rows (first, order): the sources that take the slots of each range, from one row (s, dry)."""
    first = F.when(F.col("dry") > 0, F.sequence(F.lit(0).cast("long"), F.col("dry") - 1, F.lit(slots).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    ranges = rows.select("s", "dry", F.explode(first).alias("first"))
    ranges = ranges.withColumn("end", F.least(F.col("first") + slots, "dry")).repartition("first")
    ranges = ranges.withColumn("_had", border_state(F.col("first")))

    def next_source(had: Column, slot: Column) -> Column:
        due = F.transform("s", lambda x, j: F.struct(
            whole((F.get(had, j) + 1) / x["w"], up=True).alias("due"), j.alias("j"), (whole(F.get(had, j) / x["w"]) <= slot).alias("free")))
        return F.coalesce(F.array_min(F.filter(due, lambda x: x["free"])), F.array_min(due))["j"]  # only a rounding error leaves none released

    def step(state: Column, slot: Column) -> Column:
        return let(next_source(state["had"], slot), lambda chosen: F.struct(
            F.transform(state["had"], lambda n, j: F.when(j == chosen, n + 1).otherwise(n)).alias("had"),
            F.concat(state["order"], F.array(chosen)).alias("order")))

    def stretch(state: Column, at: Column) -> Column:
        empty = F.struct(state["had"].alias("had"), F.array().cast("array<int>").alias("order"))
        return let(F.aggregate(F.sequence(at, F.least(at + FOLD, "end") - 1), empty, step), lambda done: F.struct(
            done["had"].alias("had"), F.concat(state["orders"], F.array(done["order"])).alias("orders")))

    start = F.struct(F.col("_had").alias("had"), F.array().cast("array<array<int>>").alias("orders"))
    order = F.flatten(F.aggregate(F.sequence("first", F.col("end") - 1, F.lit(FOLD).cast("long")), start, stretch)["orders"])
    return ranges.select("s", "first", order.alias("order"))


def exact_slots(sizes: DataFrame, block_docs: int, buckets: int, slots: int = RANGE) -> DataFrame:
    """Rows (key, block, slot) of all blocks, by the exact weights; `_left` tells those after the
    slot `dry` where the first source runs dry."""
    blocks = sizes.select(F.col(KEY).alias("key"), F.col("_w").alias("w"), F.ceil(F.col("_n") / block_docs).alias("n"))
    rows = blocks.agg(F.sort_array(F.collect_list(F.struct("key", "w", "n"))).alias("s"))
    total = F.aggregate("s", F.lit(0.0), lambda t, x: t + x["w"])  # in order of the keys: the same sum in every run
    rows = rows.where(F.size("s") > 0).withColumn("t", total).select(F.transform("s", lambda x: F.struct(
        x["key"].alias("key"), (x["w"] / F.col("t")).alias("w"), x["n"].alias("n"))).alias("s"))
    dry = whole(F.array_min(F.transform("s", lambda x: x["n"] / x["w"])))
    rows = materialize(rows.select("s", dry.alias("dry")), "mixing-weights")
    taken = materialize(range_orders(rows, slots), "mixing-orders").select("s", "first", F.posexplode("order").alias("at", "j"))
    taken = taken.select(F.get("s", F.col("j"))["key"].alias(KEY), F.get("s", F.col("j"))["w"].alias("_w"), (F.col("first") + F.col("at")).alias("slot"), "first")
    # a source's blocks are numbered within a range, then offset by those of the ranges before
    counts = taken.groupBy(KEY, "first").agg(F.count("*").alias("_c"))
    before = counts.select(KEY, "first", (F.sum("_c").over(W.partitionBy(KEY).orderBy("first")) - F.col("_c")).alias("_before"))  # one row a range
    within = F.row_number().over(W.partitionBy(KEY, "first").orderBy("slot")) - 1
    taken = taken.withColumn("_within", within).join(before, [KEY, "first"])
    taken = materialize(taken.select(KEY, "slot", (F.col("_before") + F.col("_within")).alias("block")), "mixing-slots")
    # the blocks left, numbered by due slot in ranges of due slots
    had = taken.groupBy(KEY).agg(F.count("*").alias("_had"))
    last = F.array_max(F.transform("s", lambda x: x["n"] / x["w"]))
    left = rows.select("dry", last.alias("_last"), F.explode("s").alias("x")).select("dry", "_last", F.col("x.key").alias(KEY), F.col("x.w").alias("_w"), F.col("x.n").alias("_n"))
    left = left.join(had, KEY, "left").withColumn("_had", F.coalesce("_had", F.lit(0).cast("long"))).where("_had < _n")
    left = left.withColumn("block", F.explode(F.sequence(F.col("_had"), F.col("_n") - 1))).withColumn("_due", (F.col("block") + 1) / F.col("_w"))
    left = left.withColumn("_range", F.least(F.floor(F.col("_due") / F.col("_last") * buckets), F.lit(buckets - 1)).cast("int"))
    counts = left.groupBy("_range").agg(F.count("*").alias("_c"))
    before = counts.select("_range", (F.sum("_c").over(W.orderBy("_range")) - F.col("_c")).alias("_before"))  # `buckets` rows at most
    within = F.row_number().over(W.partitionBy("_range").orderBy("_due", KEY, "block")) - 1
    left = left.withColumn("_within", within).join(before, "_range")
    left = left.select(KEY, "block", (F.col("dry") + F.col("_before") + F.col("_within")).alias("slot"), F.lit(True).alias("_left"))
    return taken.withColumn("_left", F.lit(False)).unionByName(left)


def number(drawn: DataFrame, buckets: int) -> DataFrame:
    """Each document's place in its source, from 0, by hash, id and text digest.

    The leading hex digits of the hash cut a source into ranges; a range's offset is the sum of
    the counts before it, a window over at most `buckets` rows a source.
    """
    cut = drawn.withColumn("_bucket", F.floor(F.conv(F.substring(RANK, 1, 6), 16, 10).cast("long") * buckets / F.lit(16 ** 6)).cast("int"))
    counts = cut.groupBy(KEY, "_bucket").agg(F.count("*").alias("_c"))
    before = F.sum("_c").over(W.partitionBy(KEY).orderBy("_bucket")) - F.col("_c")
    offsets = counts.select(KEY, "_bucket", before.alias("_before"))
    ties = [F.md5(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in ("text",) if c in drawn.columns]
    within = F.row_number().over(W.partitionBy(KEY, "_bucket").orderBy(RANK, "doc_id", *ties)) - 1
    return cut.withColumn("_within", within).join(offsets, [KEY, "_bucket"]).withColumn("_place", F.col("_before") + F.col("_within"))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, block_docs: int = BLOCK_DOCS, parts: int | None = None,
        buckets: int = BUCKETS, stop: str = "all", other: float | None = None) -> DataFrame:
    """`docs` with block (number in its source), slot (place of the block in the mixture) and
    place (the document's place in its block). Sorting by slot and place gives the mixture."""
    drawn = draw(docs.drop("block", "slot", "place"))
    sizes = weighed(source_sizes(drawn), weights, other)
    numbered = number(drawn, buckets)
    block = F.floor(F.col("_place") / block_docs)
    placed = numbered.withColumns({"block": block, "place": (F.col("_place") % block_docs).cast("int")})
    if parts is None:
        slots = exact_slots(sizes, block_docs, buckets)
        slots = slots.where("NOT _left") if stop == "first" else slots
        return placed.join(slots, [KEY, "block"]).select(*[c for c in placed.columns if c not in HELPERS], "slot")
    # written, as each is read many times over: one row, then `parts` rows
    entries = materialize(shares(sizes, parts), "mixing-shares")
    period = materialize(one_period(entries, parts), "mixing-period")
    pattern = period.groupBy(KEY).agg(F.max("_share").alias("_share"), F.sort_array(F.collect_list(F.struct("_turn", "_at"))).alias("_slots"))
    placed = placed.join(F.broadcast(pattern), KEY)  # `parts` slots in all
    slot = F.floor(F.col("block") / F.col("_share")) * parts + F.get("_slots", (F.col("block") % F.col("_share")).cast("int"))["_at"]
    placed = placed.withColumn("slot", slot)
    if stop == "first":
        blocks = sizes.join(F.broadcast(pattern), KEY).withColumn("_b", F.ceil(F.col("_n") / block_docs))
        after = F.floor(F.col("_b") / F.col("_share")) * parts + F.get("_slots", (F.col("_b") % F.col("_share")).cast("int"))["_at"]
        placed = placed.where(F.col("slot") < F.lit(blocks.agg(F.min(after)).first()[0]))
    return placed.drop(*HELPERS, "_share", "_slots")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")  # rows alike in both are interchangeable
    return mix(docs).select("doc_id", "source", "block", "slot", "place")


# one fold over all slots, of which the ranges are parts
ORACLE = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS k, md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), numbered AS (
  SELECT doc_id, source, k, row_number() OVER (PARTITION BY k ORDER BY h, doc_id) - 1 AS p FROM d
), sized AS (
  SELECT k, sqrt(count(*)) AS w, ceil(count(*) / {BLOCK_DOCS})::BIGINT AS n FROM d GROUP BY k
), packed AS (
  SELECT list(k ORDER BY k) AS ks, list(w / t ORDER BY k) AS ws, floor(round(min(n / (w / t)), 9))::BIGINT AS dry
  FROM sized, (SELECT list_reduce(list(w ORDER BY k), lambda a, b: a + b) AS t FROM sized)
), run(t, had, pick) AS (
  SELECT 0::BIGINT, list_transform(ws, lambda x: 0::BIGINT), 0::BIGINT FROM packed
  UNION ALL
  SELECT t + 1, list_transform(had, lambda n, j: CASE WHEN j = p THEN n + 1 ELSE n END), p
  FROM (SELECT t, had, list_aggregate(list_filter(list_transform(had, lambda n, j:
          CASE WHEN floor(round(n / ws[j], 9)) <= t THEN ceil(round((n + 1) / ws[j], 9))::BIGINT * 1000000 + j END), lambda x: x IS NOT NULL), 'min') % 1000000 AS p
        FROM run, packed WHERE t < dry)
), taken AS (
  SELECT ks[pick] AS k, t - 1 AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS block FROM run, packed WHERE t > 0
), had AS (
  SELECT s.k, s.n, ws[list_position(ks, s.k)] AS w, coalesce(c.c, 0) AS c, dry
  FROM sized s, packed LEFT JOIN (SELECT k, count(*) AS c FROM taken GROUP BY k) c ON c.k = s.k
), remaining AS (
  SELECT k, block, dry + row_number() OVER (ORDER BY (block + 1) / w, k, block) - 1 AS slot FROM (SELECT k, w, dry, unnest(range(c, n)) AS block FROM had)
), placed AS (SELECT k, block, slot FROM taken UNION ALL SELECT k, block, slot FROM remaining)
SELECT doc_id, source, block::BIGINT AS block, slot::BIGINT AS slot, (p % {BLOCK_DOCS})::INT AS place
FROM numbered n JOIN placed USING (k) WHERE p // {BLOCK_DOCS} = block
"""
