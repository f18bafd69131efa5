"""Look up a row per group for every fact, without dealing the facts by the group.

A role may hold a third of all sessions, so a join that deals them by role puts a third of them into one task.
The looked-up table is written first, which tells its size: up to `LOOKUP_BYTES` it is broadcast;
beyond that each of its rows is copied once for each of `SALTS` salts, and facts are dealt by group and salt.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..session import materialize

LOOKUP_BYTES, SALTS = 8 << 20, 64
SALT = "_salt"


def attach(facts: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "left", written: bool = False) -> DataFrame:
    """`facts` joined to `table`, which has one row for each key. `written` says that the table is a
    selection from a written one, so that it need not be written again."""
    keys = list(keys)
    table = table if written else materialize(table, "lookup")
    size = table.agg(F.coalesce(F.sum(F.length(F.to_json(F.struct(*table.columns)))), F.lit(0))).first()[0]
    if size <= LOOKUP_BYTES:
        return facts.join(F.broadcast(table), keys, how)
    salted = table.withColumn(SALT, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = facts.withColumn(SALT, F.pmod(F.xxhash64(*facts.columns), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, [*keys, SALT], how).drop(SALT)
