"""Fold activity into one row per user and day.

Two aggregates, both with map-side combine. The first reduces raw events to *cells*
(user, day, hour, host, device); it is the only full read of the event columns and no key of
it can be hot, since partial sums are merged before the shuffle. Everything else here reads
the much smaller cells.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import EngineConfig
from ..functions.expressions import hour_of_day, share
from . import timeline

HOURS = [f"h{h:02d}" for h in range(24)]
SESSION = ["user_id", "day"]


def user_day_spine(activity: DataFrame) -> DataFrame:
    return activity.select(*SESSION).distinct()


def _of(source: str, value: Column) -> Column:
    return F.when(F.col("source") == source, value)


def log_totals() -> list[Column]:
    """What each log contributes to a group of events. NULL fields do not count."""
    size, upload = F.col("size_mb"), F.col("upload_mb")
    return [
        F.count("*").alias("n_events"),
        F.min(_of("logon", F.col("ts"))).alias("first_logon"),
        F.max(_of("logon", F.col("ts"))).alias("last_logon"),
        F.count(_of("file", F.col("activity"))).alias("n_file_events"),
        F.sum(_of("file", size)).alias("file_volume_mb"),
        F.sum(_of("file", F.when(F.col("to_removable_media"), size))).alias("removable_mb"),
        F.count(_of("http", F.col("url"))).alias("n_http_events"),
        F.sum(_of("http", upload)).alias("http_export_mb"),
        F.count(_of("email", size)).alias("n_email_events"),
        F.sum(_of("email", size)).alias("email_volume_mb"),
        F.count(_of("email", F.when(F.col("to_domain_type") == "external", 1))).alias("email_external_count"),
    ]


def activity_cells(activity: DataFrame) -> DataFrame:
    return activity.groupBy(*SESSION, hour_of_day("ts").alias("hour"), "pc", "device_id").agg(*log_totals())


def span_minutes(first: str, last: str) -> Column:
    micros = F.expr(f"timestampdiff(MICROSECOND, {first}, {last})")
    return F.coalesce(micros / F.lit(6e7), F.lit(0.0))


def fold_cells(cells: DataFrame, distinct_counts: bool = False) -> DataFrame:
    """One row per user-day; a log that left no trace that day contributes zeros.

    The numbers of distinct hosts and devices are no model features and cost a wider shuffle
    (Spark expands the rows once per distinct column), so they are computed when asked for.
    """

    def total(name: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0.0)).alias(name)

    folded = cells.groupBy(*SESSION).agg(
        F.sum("n_events").alias("n_events"),
        F.min("first_logon").alias("first_logon"),
        F.max("last_logon").alias("last_logon"),
        *([F.count_distinct("pc").alias("n_pcs_used"),
           F.count_distinct("device_id").alias("n_device_connects")] if distinct_counts else []),
        F.sum("n_file_events").alias("n_file_events"), total("file_volume_mb"), total("removable_mb"),
        F.sum("n_http_events").alias("n_http_events"), total("http_export_mb"),
        F.sum("n_email_events").alias("n_email_events"), total("email_volume_mb"),
        F.sum("email_external_count").alias("email_external_count"),
        *[F.coalesce(F.sum(F.when(F.col("hour") == h, F.col("n_events"))), F.lit(0)).alias(c)
          for h, c in enumerate(HOURS)],
    )
    return finish_fold(folded)


def fold_activity(activity: DataFrame) -> DataFrame:
    """`fold_cells` of the activity's cells in one shuffle: where a user-day has few events, its
    cells are hardly fewer, and folding them first would deal every row twice."""
    hour = hour_of_day("ts")
    folded = (activity.withColumn("hour", hour).groupBy(*SESSION)
              .agg(*log_totals(), *[F.count_if(F.col("hour") == h).alias(c) for h, c in enumerate(HOURS)]))
    return finish_fold(folded.fillna(0.0, ["file_volume_mb", "removable_mb", "http_export_mb", "email_volume_mb"]))


def finish_fold(folded: DataFrame) -> DataFrame:
    return (folded.withColumn("session_duration_min", span_minutes("first_logon", "last_logon"))
            .withColumn("export_volume_mb", F.col("removable_mb"))
            .drop("first_logon", "last_logon"))


def attach_roles(user_days: DataFrame, directory: DataFrame) -> DataFrame:
    """Left join: users missing from the directory keep a NULL role."""
    return user_days.join(directory.select("user_id", "role"), "user_id", "left")


def attach_labels(user_days: DataFrame, answers: DataFrame) -> DataFrame:
    """Duplicate answer rows count once; days without an answer are benign."""
    labels = (answers.groupBy(*SESSION).agg(F.min("scenario_id").alias("scenario_id"))
              .withColumn("is_malicious", F.lit(True)))
    return (user_days.join(labels, SESSION, "left")
            .withColumn("is_malicious", F.coalesce("is_malicious", F.lit(False))))


def user_day_table(activity: DataFrame, directory: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    table = attach_roles(fold_cells(activity_cells(activity), distinct_counts=True), directory)
    if answers is None:
        return (table.withColumn("scenario_id", F.lit(None).cast("string"))
                .withColumn("is_malicious", F.lit(False)))
    return attach_labels(table, answers)


# ---- stand-alone statistics ----------------------------------------------------------------
def session_durations(activity: DataFrame) -> DataFrame:
    logon = activity.groupBy(*SESSION).agg(F.min(_of("logon", F.col("ts"))).alias("a"),
                                           F.max(_of("logon", F.col("ts"))).alias("b"))
    return logon.select(*SESSION, span_minutes("a", "b").alias("session_duration_min"))


def distinct_items(activity: DataFrame, item: str, count_name: str) -> DataFrame:
    """The distinct hosts (or devices) of each user-day in sorted order, one row each, with
    their number. Rows in place of an array, so a day of any width stays spillable."""
    found = activity.where(F.col(item).isNotNull()).select(*SESSION, item).distinct()
    day = Window.partitionBy(*SESSION)
    return found.select(
        *SESSION, item,
        F.row_number().over(day.orderBy(item)).cast("bigint").alias("place"),
        F.count("*").over(day).alias(count_name))


def token_rows(activity: DataFrame) -> DataFrame:
    """The two ordered sequences of a session: web domains and file activities."""
    token = _of("http", F.col("domain"))
    token = F.coalesce(token, _of("file", F.col("activity")))
    kind = F.when(F.col("source") == "http", F.lit("url")).otherwise(F.lit("file"))
    return (activity.where(F.col("source").isin("http", "file"))
            .select(*SESSION, kind.alias("kind"), "ts", "event_id", token.alias("token"))
            .where(F.col("token").isNotNull()))


def token_sequences(activity: DataFrame, cfg: EngineConfig) -> DataFrame:
    """url_sequence / file_activity_sequence as numbered rows in time order."""
    rows = timeline.position(token_rows(activity), [*SESSION, "kind"], "ts", "event_id", "place", cfg)
    return rows.select(*SESSION, "kind", "place", "token")


def hour_histogram(activity: DataFrame) -> DataFrame:
    return (activity.groupBy(*SESSION)
            .agg(*[F.count_if(hour_of_day("ts") == h).alias(c) for h, c in enumerate(HOURS)]))


def after_hours(cfg: EngineConfig) -> Column:
    """Share of a session's events outside business hours, from its 24 hour counters."""
    inside = range(cfg.business_open, cfg.business_close)
    counters = [F.col(c) for c in HOURS]
    outside = reduce(add, [F.col(c) for h, c in enumerate(HOURS) if h not in inside], F.lit(0))
    return share(outside, reduce(add, counters))
