"""Hash-chained audit table: numbering, chaining, verification, search.

One global chain cannot be written in parallel, so entries form one chain per (day, shard).
Within a chain each entry's hash covers the previous hash; the chain heads are chained in turn,
which ties the chains together and also exposes a cut-off tail. The canonical text that is
hashed is built by Spark; only the running hash itself is Python, streamed over sorted rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import EngineConfig

GENESIS = "0" * 64
ENTRY = ["chain_id", "seq", "event_time", "event_type", "payload", "prev_hash", "entry_hash"]


def shard_of(key: Column, shards: int) -> Column:
    digest = F.substring(F.sha2(key.cast("string"), 256), 1, 4)
    return F.conv(digest, 16, 10).cast("int") % shards


def chain_of(day: str, key: str, cfg: EngineConfig) -> Column:
    return F.concat_ws("/", F.date_format(day, "yyyy-MM-dd"), shard_of(F.col(key), cfg.audit_shards).cast("string"))


def with_chain(events: DataFrame, cfg: EngineConfig, key: str = "user_id") -> DataFrame:
    """Assign each event to its chain by day and key.

    Session events are keyed by user, since a user has one session a day. Events of which one
    user may have very many, such as resume requests, are keyed by their own id instead.
    """
    return events.withColumn("chain_id", chain_of("day", key, cfg))


def number_entries(events: DataFrame, cfg: EngineConfig, key: str = "user_id") -> DataFrame:
    """chain_id and the 0-based seq within it; events need day, step_no and the key."""
    order = Window.partitionBy("chain_id").orderBy(key, "step_no")
    return with_chain(events, cfg, key).withColumn("seq", F.row_number().over(order).cast("bigint") - 1)


# ---- canonical form ------------------------------------------------------------------------
def _json_string(column: str) -> Column:
    """A JSON string literal, escaped by Spark's own JSON writer."""
    quoted = F.to_json(F.array(F.col(column)))
    return F.substring(quoted, F.lit(2), F.length(quoted) - 2)


def _canonical_parts() -> tuple[Column, Column]:
    """The canonical entry before the previous hash and after the seq: keys in sorted order,
    compact, every field but the entry's own hash."""
    before = F.concat(F.lit('{"event_type":'), _json_string("event_type"), F.lit(',"payload":'), F.col("payload"),
                      F.lit(',"prev_hash":"'))
    after = F.concat(F.lit(',"timestamp":'), _json_string("event_time"), F.lit("}"))
    return before, after


SEQ = '","seq":'


def canonical_entry() -> Column:
    before, after = _canonical_parts()
    return F.concat(before, F.col("prev_hash"), F.lit(SEQ), F.col("seq").cast("string"), after)


# ---- chaining ------------------------------------------------------------------------------
def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Number and hash rows sorted by chain. Only the last hash and number pass from one Arrow
    batch to the next, so a chain of any length needs constant memory."""
    chain, last, number = None, GENESIS, 0
    for pdf in batches:
        seq, prev, own = [], [], []
        for c, before, after in zip(pdf["chain_id"], pdf["_before"], pdf["_after"]):
            if c != chain:
                chain, last, number = c, GENESIS, 0
            seq.append(number)
            prev.append(last)
            last = hashlib.sha256(f"{before}{last}{SEQ}{number}{after}".encode()).hexdigest()
            own.append(last)
            number += 1
        yield pdf[["chain_id", "event_time", "event_type", "payload"]].assign(seq=seq, prev_hash=prev, entry_hash=own)[ENTRY]


def build_chains(entries: DataFrame, order: Sequence[str] = ("seq",)) -> DataFrame:
    """Number and chain the entries of each chain_id in the given order: seq, prev_hash and
    entry_hash. One shuffle; each chain is one sorted run of one partition."""
    before, after = _canonical_parts()
    rows = entries.withColumns({"_before": before, "_after": after})
    rows = rows.select("chain_id", *order, "event_time", "event_type", "payload", "_before", "_after")
    return rows.repartition("chain_id").sortWithinPartitions("chain_id", *order).mapInPandas(
        _fold, "chain_id string, seq bigint, event_time string, event_type string, payload string, "
               "prev_hash string, entry_hash string")


def chain_heads(chained: DataFrame) -> DataFrame:
    """Last hash and length of every chain: the anchor to keep elsewhere."""
    return chained.groupBy("chain_id").agg(
        F.max_by("entry_hash", "seq").alias("head_hash"), F.count("*").alias("entries"))


def chain_the_heads(heads: DataFrame) -> DataFrame:
    """Chain the heads: those of a day into a chain `heads/day`, in parallel, and the heads of
    these, one row a day, into the chain `days`."""
    def entries(found: DataFrame, chain: Column, kind: str) -> DataFrame:
        return found.select(
            chain.alias("chain_id"), F.split("chain_id", "/").alias("_parts"), F.col("chain_id").alias("_order"), F.lit(kind).alias("event_type"),
            F.to_json(F.struct("chain_id", "entries", "head_hash")).alias("payload"))

    def chained(rows: DataFrame, day: Column) -> DataFrame:
        return build_chains(rows.withColumn("event_time", day).drop("_parts"), ["_order"])

    day = F.split("chain_id", "/")[0]
    of_day = chained(entries(heads, F.concat(F.lit("heads/"), day), "chain_head"), F.col("_parts")[0])
    of_all = chained(entries(chain_heads(of_day), F.lit("days"), "day_head"), F.col("_parts")[1])
    return of_day.unionByName(of_all)


# ---- verification --------------------------------------------------------------------------
def verify(chained: DataFrame, order: str = "seq") -> DataFrame:
    """(chain_id, seq, ok, error) per entry. A broken link is blamed on the entry after the
    gap, and checking goes on from the hash stored there. An entry without a number could not
    be read; it is flagged itself, and so is the entry after it."""
    before = F.lag("entry_hash").over(Window.partitionBy("chain_id").orderBy(order))
    rows = (chained.withColumn("_expected", F.coalesce(before, F.lit(GENESIS)))
            .withColumn("_own", F.sha2(canonical_entry(), 256)))
    error = (F.when(F.col("seq").isNull(), F.lit("unreadable"))
             .when(~F.col("prev_hash").eqNullSafe(F.col("_expected")), F.lit("chain break"))
             .when(~F.col("entry_hash").eqNullSafe(F.col("_own")), F.lit("hash mismatch")))
    return (rows.withColumn("error", error)
            .select("chain_id", "seq", F.col("error").isNull().alias("ok"), "error"))


def verify_entries(chained: DataFrame) -> DataFrame:
    """Self-check alone: does the stored hash fit the entry? No shuffle."""
    fits = F.col("entry_hash").eqNullSafe(F.sha2(canonical_entry(), 256))
    return chained.select("chain_id", "seq", fits.alias("ok"))


def verify_heads(chained: DataFrame, heads: DataFrame) -> DataFrame:
    """Compare with kept heads; finds cut tails and missing chains, which links cannot show."""
    now = chain_heads(chained).withColumnsRenamed({"head_hash": "found_hash", "entries": "found_entries"})
    both = heads.join(now, "chain_id", "full")
    same = F.col("head_hash").eqNullSafe(F.col("found_hash")) & F.col("entries").eqNullSafe(F.col("found_entries"))
    return both.select("chain_id", "entries", "found_entries", same.alias("ok"))


def verify_summary(results: DataFrame) -> DataFrame:
    return results.agg(F.count("*").alias("total"), F.count_if("ok").alias("verified"),
                       F.count_if(~F.col("ok")).alias("flagged"))


# ---- tamper drills -------------------------------------------------------------------------
def middle_entry(chained: DataFrame) -> DataFrame:
    """The entry at position n // 2 of every chain."""
    return chained.groupBy("chain_id").agg(F.floor(F.count("*") / 2).alias("_middle"))


def tamper(chained: DataFrame, kind: str) -> DataFrame:
    """Damage the middle entry of every chain: 'edit' its payload, 'delete' it, 'reorder' it
    with its predecessor, or 'insert' a copy after it. `pos` is the resulting log order."""
    rows = chained.join(middle_entry(chained), "chain_id").withColumn("pos", F.col("seq").cast("double"))
    hit = F.col("seq") == F.col("_middle")
    if kind == "edit":
        rows = rows.withColumn("payload", F.when(hit, F.lit('{"risk_score":"1.000000"}')).otherwise(F.col("payload")))
    elif kind == "delete":
        rows = rows.where(~hit)
    elif kind == "reorder":
        rows = rows.withColumn("pos", F.when(hit & (F.col("_middle") > 0), F.col("pos") - 1.5).otherwise(F.col("pos")))
    elif kind == "insert":
        extra = rows.where(hit).withColumn("pos", F.col("pos") + 0.5)
        rows = rows.unionByName(extra)
    else:
        raise ValueError(f"unknown drill: {kind}")
    return rows.drop("_middle")


# ---- search --------------------------------------------------------------------------------
def search(chained: DataFrame, term: str = "", limit: int = 100, latest: int = 30) -> DataFrame:
    """First `limit` entries whose type or user contains the term; the latest entries if the
    term is empty. Log order is (chain_id, seq)."""
    if not term:
        return chained.orderBy(F.col("chain_id").desc(), F.col("seq").desc()).limit(latest)
    needle = F.lit(term.lower())
    user = F.coalesce(F.get_json_object("payload", "$.user"), F.lit(""))
    hit = F.lower("event_type").contains(needle) | F.lower(user).contains(needle)
    return chained.where(hit).orderBy("chain_id", "seq").limit(limit)


def pick_entry(chained: DataFrame) -> DataFrame:
    """The first scored Critical session, else the first entry."""
    critical = (F.col("event_type") == "session_scored") & (F.get_json_object("payload", "$.risk_tier") == "Critical")
    place = F.struct("chain_id", "seq")
    entry = F.struct(*[c for c in ENTRY if c in chained.columns])
    both = chained.agg(F.min_by(entry, F.when(critical, place)).alias("c"), F.min_by(entry, place).alias("f"))
    return both.select(F.coalesce("c", "f").alias("e")).where("e IS NOT NULL").select("e.*")
