"""A versioned store of models: tables and settings that are published together or not at all.

A save writes the tables into a folder of its own, counts and sums them up as they were written,
and then appends one manifest row that names them: a single file, which Spark's committer moves into place in one
step. A reader starts from the manifests, so it sees a model whole or not at all; before use it
counts the tables again and refuses a version whose files were lost or changed since. Versions are
never overwritten, and a save that breaks off leaves nothing that a reader would look at.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

MANIFEST = "version bigint, ident string, saved_at timestamp, settings string, parts array<struct<name: string, entries: bigint, checksum: string>>"


class TornModel(ValueError):
    """A part of the version is missing or differs from what was saved."""


def _summary(df: DataFrame) -> tuple[int, str]:
    """Rows and a sum over them that no order changes."""
    row = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
    return row.n, str(row.s)


def manifests(spark: SparkSession, folder: str) -> DataFrame:
    """All published versions; none where nothing was ever saved."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{folder}/manifests")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], MANIFEST)


def publish(spark: SparkSession, folder: str, parts: dict[str, DataFrame], settings: dict[str, Any]) -> int:
    """Save a version and return its number. Savers at the same time may get the same number;
    each has its own tables, and `read` takes the one with the greatest ident."""
    ident, found = uuid.uuid4().hex, []
    for name, df in sorted(parts.items()):
        path = f"{folder}/parts/{ident}/{name}"
        df.write.parquet(path)
        found.append((name, *_summary(spark.read.parquet(path))))
    version = (manifests(spark, folder).agg(F.max("version")).first()[0] or 0) + 1
    row = spark.createDataFrame([(version, ident, None, json.dumps(settings), found)], MANIFEST).withColumn("saved_at", F.current_timestamp())
    row.coalesce(1).write.mode("append").parquet(f"{folder}/manifests")
    return version


def read(spark: SparkSession, folder: str, version: int | None = None) -> tuple[dict[str, DataFrame], dict[str, Any]]:
    """Tables and settings of a version, by default the latest."""
    rows = manifests(spark, folder)
    rows = rows if version is None else rows.where(F.col("version") == version)
    chosen = rows.orderBy(F.desc("version"), F.desc("ident")).first()
    if chosen is None:
        raise FileNotFoundError(f"no model {'' if version is None else f'of version {version} '}in {folder}")
    parts = {}
    for name, entries, checksum in chosen.parts:
        try:
            parts[name] = spark.read.parquet(f"{folder}/parts/{chosen.ident}/{name}")
            same = _summary(parts[name]) == (entries, checksum)
        except Exception as e:  # noqa: BLE001
            raise TornModel(f"part {name} of version {chosen.version} cannot be read") from e
        if not same:
            raise TornModel(f"part {name} of version {chosen.version} is not as it was saved")
    return parts, json.loads(chosen.settings)
