"""Adapter from the supplied `events` and `customer` tables to the engine's inputs.

`activity` reads the event table once and maps each row to its log by a CASE projection, so
the whole engine runs from a single scan; `logs` gives the same rows as five separate frames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..config import EngineConfig
from ..functions.expressions import calendar_day
from ..operators import timeline
from .schemas import LOG_SCHEMAS

# ---- fixed values: event type of each log ------------------------------------------------
EVENT_TYPE = {"logon": "signup", "device": "error", "file": "purchase", "http": "view", "email": "click"}
# ------------------------------------------------------------------------------------------


# An object that holds nothing but a plain number k; any other text goes through the JSON parser.
ONLY_K = r'^\{"k": ?(0|[1-9][0-9]{0,8})\}\z'


def number_k(props: str) -> Column:
    """The text of `k` in a JSON object. The parser costs several times all the rest of reading a
    row, so the plainest objects, which a pattern tells exactly, are spared it."""
    plain = F.translate(props, '{"k: }', "")
    return F.when(F.col(props).rlike(ONLY_K), plain).otherwise(F.get_json_object(props, "$.k"))


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    return raw.select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"),
                      calendar_day("ts").alias("day"), "user_id", "event_type", "value",
                      number_k("props").cast("int").alias("k"))


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _log_columns() -> dict[str, dict[str, Column]]:
    u, k, value = F.col("user_id"), F.col("k"), F.col("value")
    domain = _text("site-", k % 12, ".example")
    return {
        "logon": {"activity": F.when(k % 2 == 0, F.lit("Logon")).otherwise(F.lit("Logoff"))},
        "device": {"activity": F.lit("Connect"), "device_id": _text("USB-", u, "-", k % 8)},
        "file": {
            "filename": _text("f/file_", k, ".dat"),
            "activity": F.when(k < 60, F.lit("Open")).when(k < 85, F.lit("Write"))
                         .when(k < 95, F.lit("Copy")).otherwise(F.lit("Delete")),
            "size_mb": value,
            "to_removable_media": k.between(85, 94) & (k % 2 == 1),
        },
        "http": {
            "domain": domain,
            "url": _text("https://", domain, "/path", k),
            "category": _text("cat", k % 6),
            "upload_mb": F.when(k >= 90, value).otherwise(F.lit(0.0)),
        },
        "email": {
            "to_domain_type": F.when(k % 5 == 0, F.lit("external")).otherwise(F.lit("internal")),
            "size_mb": value,
            "attachments": k % 3,
        },
    }


def _host() -> Column:
    u, k = F.col("user_id"), F.col("k")
    return F.when(k < 80, _text("PC-", u, "-0")).otherwise(_text("PC-", u, "-", k % 5))


def activity(events: DataFrame) -> DataFrame:
    """All five logs in the activity layout, from one pass over the events."""
    from .schemas import ACTIVITY_COLUMNS

    logs = _log_columns()

    def pick(column: str) -> Column:
        chain = F
        for log, cells in logs.items():
            if column in cells:
                chain = chain.when(F.col("event_type") == EVENT_TYPE[log], cells[column])
        return chain

    source = F
    for log, kind in EVENT_TYPE.items():
        source = source.when(F.col("event_type") == kind, F.lit(log))
    given = {"event_id": F.col("event_id"), "ts": F.col("ts"), "day": F.col("day"),
             "source": source, "pc": _host()}
    cells = [(given[c] if c in given else pick(c)).cast(kind).alias(c)
             for c, kind in ACTIVITY_COLUMNS.items()]
    return (events.where(F.col("event_type").isin(list(EVENT_TYPE.values())))
            .select("user_id", *cells))


def logs(events: DataFrame) -> dict[str, DataFrame]:
    out = {}
    for log, cells in _log_columns().items():
        given = {"date": F.col("ts"), "user": F.col("user_id"), "pc": _host(), **cells}
        rows = events.where(F.col("event_type") == EVENT_TYPE[log])
        out[log] = rows.select("event_id", *[given[c].alias(c) for c in LOG_SCHEMAS[log].names])
    return out


def directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return customers.select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("role"))


def day_peaks(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id", "day").agg(F.max("value").alias("max_value"))


def answers(events: DataFrame, roles: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Ground truth by rule: held-out user-days whose greatest value reaches 200."""
    late = events.where(F.col("day") >= F.lit(cfg.split_day))
    flagged = day_peaks(late).where(F.col("max_value") >= 200)
    return (flagged.join(roles, "user_id", "left")
            .select("user_id", "role", _text("SCN_", F.col("role")).alias("scenario_id"), "day"))


def entitlements(roles: DataFrame) -> DataFrame:
    return (roles.select("role").distinct().where("role <> 'FURNITURE'")
            .select("role", _text("SECRET-", F.col("role")).alias("secret_id")))


# ---- ledger inputs -------------------------------------------------------------------------
def lease_grants(events: DataFrame) -> DataFrame:
    return events.where("event_type = 'signup'").select(
        F.col("event_id").alias("lease_id"), "user_id", F.col("ts").alias("issued_at"),
        F.col("event_id").alias("issued_ord"),
        F.expr("ts + make_interval(0, 0, 0, 0, k + 1)").alias("expires_at"))


def _with_latest_grant(events: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Each purchase or click with the lease its user was granted last, if any."""
    rows = events.where("event_type IN ('signup', 'purchase', 'click')")
    lease = F.when(F.col("event_type") == "signup", F.col("event_id"))
    return timeline.last_seen(rows, ["user_id"], "ts", "event_id", lease, "lease_id", cfg)


def redeem_attempts(events: DataFrame, cfg: EngineConfig) -> DataFrame:
    return (_with_latest_grant(events, cfg).where("event_type = 'purchase'")
            .select(F.col("event_id").alias("attempt_id"), F.col("ts").alias("at"), "user_id", "lease_id"))


def single_revokes(events: DataFrame, cfg: EngineConfig) -> DataFrame:
    return (_with_latest_grant(events, cfg)
            .where("event_type = 'click' AND k >= 90 AND lease_id IS NOT NULL")
            .select(F.col("event_id").alias("revoke_id"), F.col("ts").alias("at"), "user_id", "lease_id"))


def bulk_revokes(events: DataFrame) -> DataFrame:
    return (events.where("event_type = 'error' AND k >= 80")
            .select(F.col("event_id").alias("bulk_id"), F.col("ts").alias("at"), "user_id"))


def quarantine_events(events: DataFrame) -> DataFrame:
    return (events.where("event_type = 'error' AND k >= 80")
            .select(F.col("event_id").alias("quarantine_id"), F.col("ts").alias("at"), "user_id",
                    _text("error k=", F.col("k")).alias("reason")))


def resume_requests(events: DataFrame) -> DataFrame:
    k = F.col("k")
    approver = (F.when(k % 4 == 0, F.col("user_id").cast("string")).when(k % 4 == 1, F.lit(""))
                .otherwise(_text("approver-", k)))
    return (events.where("event_type = 'click' AND k < 20")
            .select(F.col("event_id").alias("request_id"), F.col("ts").alias("at"), "user_id",
                    approver.alias("approver")))
