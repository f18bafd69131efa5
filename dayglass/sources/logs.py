"""Read the five activity logs, the directory and the answers; fold logs into one frame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.expressions import calendar_day
from .schemas import ACTIVITY_COLUMNS, ANSWERS_SCHEMA, DIRECTORY_SCHEMA, LOG_SCHEMAS

BAD_ROW = "_bad_row"


def read_table(spark: SparkSession, path: str, schema: StructType, fmt: str = "csv",
               keep_bad_rows: bool = False) -> DataFrame:
    """Read with a declared schema; nothing is ever inferred. CSV rows that do not parse or lack
    their key go to `read_rejects`, or are kept with their text in a `_bad_row` column when asked."""
    if fmt != "csv":
        return spark.read.schema(schema).format(fmt).load(path)
    wide = StructType(schema.fields + [StructField(BAD_ROW, StringType(), True)])
    rows = (spark.read.schema(wide)
            .options(header="true", mode="PERMISSIVE", columnNameOfCorruptRecord=BAD_ROW)
            .csv(path))
    if keep_bad_rows:
        return rows
    return rows.where(_usable(schema)).drop(BAD_ROW)


def _usable(schema: StructType) -> Column:
    """The key column comes first in every schema; a row without its key is no use either."""
    return F.col(BAD_ROW).isNull() & F.col(schema.names[0]).isNotNull()


def read_rejects(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """(reason, line) of the CSV rows that `read_table` leaves out; the line of a row without a
    key is its parsed content as JSON."""
    rows = read_table(spark, path, schema, keep_bad_rows=True).where(~_usable(schema))
    unparsed = F.col(BAD_ROW).isNotNull()
    return rows.select(F.when(unparsed, F.lit("unparsable")).otherwise(F.lit("no key")).alias("reason"),
                       F.coalesce(F.col(BAD_ROW), F.to_json(F.struct(*schema.names))).alias("line"))


def read_log_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """(source, reason, line) of all rows that `read_logs` leaves out of CSV logs."""
    return reduce(DataFrame.unionByName, [
        read_rejects(spark, f"{folder}/{name}.csv", schema).select(F.lit(name).alias("source"), "reason", "line")
        for name, schema in LOG_SCHEMAS.items()])


def read_logs(spark: SparkSession, folder: str, fmt: str = "csv") -> dict[str, DataFrame]:
    return {name: read_table(spark, f"{folder}/{name}.{fmt}", schema, fmt)
            for name, schema in LOG_SCHEMAS.items()}


def read_directory(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """One row per user: the latest hired, among those the greatest role."""
    rows = read_table(spark, path, DIRECTORY_SCHEMA, fmt).withColumnRenamed("user", "user_id")
    names = [c for c in rows.columns if c != "user_id"]
    order = sorted(names, key=lambda c: ["hire_date", "role"].index(c) if c in ("hire_date", "role") else 2)
    return rows.groupBy("user_id").agg(F.max(F.struct(*order)).alias("_row")).select("user_id", *[f"_row.{c}" for c in names])


def read_answers(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    rows = read_table(spark, path, ANSWERS_SCHEMA, fmt)
    return answer_days(rows.select(F.col("user").alias("user_id"), calendar_day("date").alias("day"),
                                   "scenario_id"))


def answer_days(rows: DataFrame) -> DataFrame:
    """One label per user-day, whatever the number of answer rows."""
    return rows.groupBy("user_id", "day").agg(F.min("scenario_id").alias("scenario_id"))


def _event_id(log: DataFrame) -> Column:
    """Logs without an event number get a stable one from their content, for tie-breaks."""
    if "event_id" in log.columns:
        return F.col("event_id")
    return F.xxhash64(*[F.col(c) for c in log.columns])


def unify_logs(logs: dict[str, DataFrame]) -> DataFrame:
    """Union of the logs in the activity layout. Absent or empty logs need no special case."""

    def project(name: str, log: DataFrame) -> DataFrame:
        user = "user_id" if "user_id" in log.columns else "user"
        given = {"event_id": _event_id(log), "ts": F.col("date"), "day": calendar_day("date"),
                 "source": F.lit(name)}
        cells = [F.col(user).alias("user_id")]
        for column, kind in ACTIVITY_COLUMNS.items():
            value = given.get(column, F.col(column) if column in log.columns else F.lit(None))
            cells.append(value.cast(kind).alias(column))
        return log.select(*cells)

    return reduce(DataFrame.unionByName, [project(n, logs[n]) for n in LOG_SCHEMAS if n in logs])
