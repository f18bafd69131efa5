"""Streaming user-days: fold, rolling hour entropy, first-seen flags.

Event time is the activity's own `ts` read as UTC. A day is emitted once, when the watermark
has passed its end; events later than the watermark allows are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import EngineConfig
from ..functions.expressions import epoch_micros, hour_of_day
from ..operators.features import with_entropy
from ..operators.sessions import HOURS, finish_fold, log_totals

EVENT_TIME = "event_time"


def with_event_time(activity: DataFrame, delay: str) -> DataFrame:
    """Zone-free timestamps cannot carry a watermark; the instant is the same in any zone."""
    return activity.withColumn(EVENT_TIME, F.timestamp_micros(epoch_micros("ts"))).withWatermark(EVENT_TIME, delay)


def _day(instant: Column, shift: int = 0) -> Column:
    days = F.floor(F.unix_seconds(instant) / 86400).cast("int") + F.lit(shift)
    return F.date_from_unix_date(days)


def stream_user_days(activity: DataFrame, delay: str = "1 day") -> DataFrame:
    """One row per user-day, equal to the batch fold of the same events."""
    hours = [F.count_if(hour_of_day("ts") == h).alias(c) for h, c in enumerate(HOURS)]
    folded = (with_event_time(activity, delay)
              .groupBy("user_id", F.window(EVENT_TIME, "1 day").alias("w")).agg(*log_totals(), *hours))
    sums = ["file_volume_mb", "removable_mb", "http_export_mb", "email_volume_mb"]
    filled = folded.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in sums})
    return finish_fold(filled.withColumn("day", _day(F.col("w.start")))).drop("w")


def stream_hour_entropy(activity: DataFrame, cfg: EngineConfig, delay: str = "1 day") -> DataFrame:
    """Entropy of event hours over the last `hour_window_days` days, for active days only."""
    days = cfg.hour_window_days
    last_day = F.unix_seconds(F.col("w.end")) - 86400
    counted = with_event_time(activity, delay).select(
        "user_id", EVENT_TIME, hour_of_day("ts").alias("hour"),
        F.window(EVENT_TIME, f"{days} days", "1 day").alias("w"))
    counts = counted.groupBy("user_id", "w").agg(
        *[F.count_if(F.col("hour") == h).alias(c) for h, c in enumerate(HOURS)],
        F.count_if(F.unix_seconds(EVENT_TIME) >= last_day).alias("today"))
    active = counts.where("today > 0").withColumn("day", _day(F.col("w.end"), -1))
    return with_entropy(active, HOURS, "hour_entropy_7d").select("user_id", "day", "hour_entropy_7d")


ANY_DAY = "day"


class FirstSeen(StatefulProcessor):
    """Per user: first active day and the hosts and devices known so far."""

    def __init__(self, warmup_days: int):
        self.warmup_days = warmup_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.start = handle.getValueState("start", "day int")
        self.known = handle.getMapState("known", "kind string, item string", "day int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        """One frame after the other, in whatever order of days: between frames only the first day
        of each item that is new in this batch is kept."""
        start = self.start.get()[0] if self.start.exists() else None
        new: dict[tuple[str, str], int] = {}
        for frame in rows:
            for day, kind, item in zip(frame["day_number"].tolist(), frame["kind"], frame["item"]):
                start = day if start is None else min(start, day)
                if kind != ANY_DAY and not self.known.containsKey((kind, item)):
                    new[kind, item] = min(day, new.get((kind, item), day))
        if start is not None:
            self.start.update((start,))
        flagged: dict[int, dict[str, int]] = {}
        for (kind, item), day in new.items():
            self.known.updateValue((kind, item), (day,))
            if day - start >= self.warmup_days:
                flagged.setdefault(day, {"host": 0, "device": 0})[kind] = 1
        if flagged:
            yield pd.DataFrame([(key[0], d, f["host"], f["device"]) for d, f in sorted(flagged.items())],
                               columns=["user_id", "day_number", "new_host_flag", "new_device_flag"])

    def close(self) -> None:
        pass


def stream_new_flags(activity: DataFrame, cfg: EngineConfig, delay: str = "1 day") -> DataFrame:
    """Days on which a user's host or device is new after the warm-up.

    Events are first reduced to one row per (user, day, item) by a windowed aggregate, which
    runs map-side too, so the per-user state sees few rows even of a very busy user.
    """
    items = F.array(F.struct(F.lit("host").alias("kind"), F.col("pc").alias("item")),
                    F.struct(F.lit("device").alias("kind"), F.col("device_id").alias("item")),
                    F.struct(F.lit(ANY_DAY).alias("kind"), F.lit("").alias("item")))  # a day without either starts the warm-up too
    daily = (with_event_time(activity, delay).select("user_id", EVENT_TIME, F.explode(items).alias("i"))
             .where("i.item IS NOT NULL")
             .groupBy("user_id", F.window(EVENT_TIME, "1 day").alias("w"), "i.kind", "i.item").count())
    rows = daily.select("user_id", "kind", "item",
                        F.floor(F.unix_seconds(F.col("w.start")) / 86400).cast("int").alias("day_number"))
    kind = dict(activity.dtypes)["user_id"]
    flags = rows.groupBy("user_id").transformWithStateInPandas(
        FirstSeen(cfg.warmup_days),
        f"user_id {kind}, day_number int, new_host_flag int, new_device_flag int", "Append", "None")
    return flags.select("user_id", F.date_from_unix_date("day_number").alias("day"), "new_host_flag", "new_device_flag")
