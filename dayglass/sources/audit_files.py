"""Audit log as JSON lines, one folder per chain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .schemas import AUDIT_SCHEMA

BAD_LINE = "bad_line"
LINE = sorted(f.name for f in AUDIT_SCHEMA.fields if f.name != "chain_id")


def write_audit(chained: DataFrame, folder: str) -> None:
    """One JSON object per line with sorted keys. Each chain lands in one file, in order."""
    (chained.select("chain_id", *LINE).repartition("chain_id").sortWithinPartitions("chain_id", "seq")
     .write.partitionBy("chain_id").json(folder, ignoreNullFields=False))


def read_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Read for verification; nothing but the log is needed. Blank lines are skipped. A line that
    does not parse stays as a row with its text in `bad_line`, which `verify` flags."""
    lines = spark.read.schema("value string, chain_id string").text(folder).where(F.trim("value") != "")
    fields = StructType([f for f in AUDIT_SCHEMA.fields if f.name != "chain_id"] + [StructField(BAD_LINE, StringType())])
    entry = F.from_json("value", fields, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD_LINE})
    return lines.select("chain_id", entry.alias("entry")).select("chain_id", "entry.*").select(*AUDIT_SCHEMA.names, BAD_LINE)
