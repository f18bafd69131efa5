"""Session construction and lineage cuts that survive executor loss."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# The JVM does not compile methods above 8,000 bytes of bytecode; it interprets them, ten times
# slower. Wide expressions (ten features, 24 hour counters) outgrow that when fused into one
# stage, so let Spark fall back to its split projections there.
TUNING = {"spark.sql.codegen.hugeMethodLimit": "8000"}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the performance settings to a session made elsewhere, unless it has its own."""
    own = spark.conf.getAll  # settings of start-up and of run time, without defaults
    for key, value in TUNING.items():
        if key not in own:
            spark.conf.set(key, value)
    return spark


def build_session(app: str = "dayglass", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this library is tuned for; callers may override any."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **TUNING,
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The shared folder for cut lineage, as the session names it.

    Only a local master may fall back to a folder of its own: on a cluster a machine-local
    folder would vanish with its executor, so there an unset folder is an error.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="dayglass-"))
    return sc.getCheckpointDir().rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    Used where one result feeds several jobs. Unlike `persist` the copy outlives executors,
    and unlike `checkpoint` it is columnar, so each reader still prunes columns.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
