"""Schemas of the activity logs, the user directory and the answers table."""

from __future__ import annotations

from pyspark.sql.types import (
    BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType,
    TimestampNTZType,
)


def _schema(*fields) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in fields])


_TS, _S, _D, _B = TimestampNTZType(), StringType(), DoubleType(), BooleanType()

# ---- fixed values: column names, order and types of each log ----------------------------
LOG_SCHEMAS: dict[str, StructType] = {
    "logon": _schema(("date", _TS), ("user", _S), ("pc", _S), ("activity", _S)),
    "device": _schema(("date", _TS), ("user", _S), ("pc", _S), ("activity", _S), ("device_id", _S)),
    "file": _schema(("date", _TS), ("user", _S), ("pc", _S), ("filename", _S), ("activity", _S),
                    ("size_mb", _D), ("to_removable_media", _B)),
    "http": _schema(("date", _TS), ("user", _S), ("pc", _S), ("url", _S), ("domain", _S),
                    ("category", _S), ("upload_mb", _D)),
    "email": _schema(("date", _TS), ("user", _S), ("pc", _S), ("to_domain_type", _S),
                     ("size_mb", _D), ("attachments", IntegerType())),
}
DIRECTORY_SCHEMA = _schema(("user", _S), ("role", _S), ("hire_date", _TS), ("is_night_shift", _B))
ANSWERS_SCHEMA = _schema(("user", _S), ("role", _S), ("scenario_id", _S), ("date", _TS))
# ---- end of fixed values ----------------------------------------------------------------

SOURCES = tuple(LOG_SCHEMAS)

# The unified activity frame: one row per event of any log; columns a log lacks are NULL.
ACTIVITY_COLUMNS: dict[str, str] = {
    "event_id": "bigint",
    "ts": "timestamp_ntz",
    "day": "date",
    "source": "string",
    "pc": "string",
    "activity": "string",
    "device_id": "string",
    "filename": "string",
    "size_mb": "double",
    "to_removable_media": "boolean",
    "url": "string",
    "domain": "string",
    "category": "string",
    "upload_mb": "double",
    "to_domain_type": "string",
    "attachments": "int",
}

AUDIT_SCHEMA = StructType([
    StructField("chain_id", _S), StructField("seq", LongType()), StructField("event_time", _S),
    StructField("event_type", _S), StructField("payload", _S), StructField("prev_hash", _S),
    StructField("entry_hash", _S),
])
