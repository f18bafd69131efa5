"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

WORD = r"[^\x20\x09-\x0D]+"
WHITE = r"[\x20\x09-\x0D]+"
FILTER_BITS = 1 << 26  # of a filter of ids, at most: 8 MB
BATCH_ROWS = 500  # rows that a Python worker turns into objects at a time


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def id_remainder(divisor: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo `divisor`; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % divisor


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once, also where a lambda refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def map_columns(df: DataFrame, schema: str | T.StructType, work: Callable[..., Iterator[list]]) -> DataFrame:
    """`work` once for each partition: it takes an iterator of record batches and yields lists
    of columns (Arrow arrays, NumPy arrays or lists) in the order of `schema`."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(schema)

    def run(batches):
        for columns in work(batches):
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return df.mapInArrow(run, schema)


def with_columns(df: DataFrame, fields: str, work: Callable[..., list], setup: Callable | None = None) -> DataFrame:
    """`df` without columns of the new names, followed by the new columns that `work` makes of
    each record batch. Row order and all other columns stay. With `setup`, what it returns is
    made once for each partition and given to `work` as well."""
    added = T._parse_datatype_string(fields)
    kept = [c for c in df.columns if c not in added.names]

    def each(batches):
        state = (setup(),) if setup else ()
        for batch in (b.slice(at, BATCH_ROWS) for b in batches for at in range(0, b.num_rows, BATCH_ROWS)):
            old = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield [*old, *work(batch, *state)]

    return map_columns(df, T.StructType([df.schema[c] for c in kept] + added.fields), each)


class Memo(dict):
    """A function's results by argument. Only the first `most` are kept (frequent words come
    early), so that a worker's memory stays bounded whatever the number of distinct words."""

    def __init__(self, function: Callable, most: int = 400_000):
        super().__init__()
        self.function, self.most = function, most

    def __missing__(self, key):
        value = self.function(key)
        if len(self) < self.most:
            self[key] = value
        return value


def id_filter(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of column `_h`, two bits each: 16 bits for each id up to FILTER_BITS. Beyond
    that more of the other ids pass."""
    bits = 1 << 10
    while bits < min(16 * ids.count(), FILTER_BITS):
        bits *= 2
    place = F.explode(F.array(F.col("_h"), F.shiftrightunsigned("_h", 32))).alias("_p")
    place = ids.select(place).select(F.col("_p").bitwiseAND(bits - 1).alias("_p"))
    words = place.groupBy(F.shiftright("_p", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(_p & 63 AS INT))")).alias("word")).collect()  # FILTER_BITS / 64 at most
    out = np.zeros(bits // 64, np.int64)
    for row in words:
        out[row.at] = row.word
    return out.view(np.uint64)


def may_hold(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    hashes, last = hashes.view(np.uint64), np.uint64(len(words) * 64 - 1)
    return np.logical_and(*(words[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1) for p in (hashes & last, hashes >> np.uint64(32) & last)))
