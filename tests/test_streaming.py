"""Each streaming job, replayed from files, equals its batch twin."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from dayglass.operators import features, ledgers, sessions
from dayglass.sources import events as source
from dayglass.streaming import ledgers as stream_ledgers
from dayglass.streaming import sessions as stream

FLUSH = dt.datetime(2024, 6, 1)


@pytest.fixture(scope="module")
def replay(spark, tmp_path_factory):
    """Write rows in time-ordered files, then stream them one file at a time."""

    def make(df, ts, files=4):
        folder = str(tmp_path_factory.mktemp("replay"))
        bounds = df.agg(F.min(ts), F.max(ts)).first()
        step = (bounds[1] - bounds[0]) / files
        for i in range(files):
            low = bounds[0] + i * step
            part = df.where((F.col(ts) >= F.lit(low)) & (F.col(ts) < F.lit(low + step) if i < files - 1 else F.lit(True)))
            part.coalesce(1).write.mode("append").parquet(folder)
        return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)

    return make


def drain(df, name, tmp_path):
    query = (df.writeStream.format("memory").queryName(name).outputMode("append")
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    query.awaitTermination(240)
    assert query.exception() is None
    return df.sparkSession.table(name)


def with_flush(activity):
    """A far later event of an extra user closes every real day."""
    extra = activity.limit(1).withColumns({"user_id": F.lit(-1).cast("bigint"), "ts": F.lit(FLUSH).cast("timestamp_ntz"),
                                           "day": F.lit(FLUSH.date())})
    return activity.unionByName(extra)


def same(a, b):
    columns = sorted(a.columns)
    key = lambda r: tuple(str(v) for v in r)

    def rows(df):
        cells = [F.round(c, 6) if k == "double" else F.col(c) for c, k in df.select(*columns).dtypes]
        return sorted((tuple(r) for r in df.select(*cells).collect()), key=key)

    left, right = rows(a), rows(b)
    assert len(left) == len(right)
    assert left == right


def test_user_days(inputs, replay, tmp_path):
    streamed = drain(stream.stream_user_days(replay(with_flush(inputs.activity), "ts")), "t1", tmp_path)
    batch = sessions.fold_cells(sessions.activity_cells(inputs.activity))
    same(streamed.where("user_id >= 0").select(*batch.columns), batch)


def test_late_events_are_dropped(spark, inputs, replay, tmp_path):
    folder = str(tmp_path / "in")
    rows = inputs.activity.where("day <= DATE'2024-01-03'")
    rows.coalesce(1).write.parquet(folder)
    with_flush(rows).where("user_id < 0").coalesce(1).write.mode("append").parquet(folder)
    late = rows.limit(1).withColumns({"user_id": F.lit(-2).cast("bigint")})
    late.coalesce(1).write.mode("append").parquet(folder)
    feed = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    streamed = drain(stream.stream_user_days(feed), "t1late", tmp_path)
    assert streamed.where("user_id = -2").count() == 0


def test_hour_entropy(inputs, replay, cfg, tmp_path):
    feed = replay(with_flush(inputs.activity), "ts")
    streamed = drain(stream.stream_hour_entropy(feed, cfg), "t2", tmp_path).where("user_id >= 0")
    batch = features.rolling_entropies(inputs.user_days, cfg).select("user_id", "day", "hour_entropy_7d")
    same(streamed, batch)


def test_first_seen(inputs, replay, cfg, tmp_path):
    feed = replay(with_flush(inputs.activity), "ts")
    streamed = drain(stream.stream_new_flags(feed, cfg), "t3", tmp_path).where("user_id >= 0")
    cells = sessions.activity_cells(inputs.activity)
    same(streamed, features.new_item_days(cells, sessions.user_day_spine(inputs.activity), cfg))


def test_first_seen_of_a_busy_user(spark, inputs, cfg, replay, tmp_path):
    """Items in many Arrow batches and out of order, after a first day without host and device."""
    one = inputs.activity.limit(1)
    day = lambda n: F.date_add(F.lit(cfg.start_day), n)
    first = one.withColumns({"day": day(F.lit(0)), "pc": F.lit(None).cast("string"), "device_id": F.lit(None).cast("string")})
    later = spark.range(6000).crossJoin(one.drop("pc", "device_id")).withColumns({
        "day": day((F.pmod(F.xxhash64("id"), F.lit(12)) + 1).cast("int")), "pc": F.concat(F.lit("pc"), F.col("id") % 900),
        "device_id": F.when(F.col("id") % 3 == 0, F.concat(F.lit("usb"), F.col("id") % 700))}).drop("id")
    rows = first.unionByName(later).withColumn("ts", F.col("day").cast("timestamp_ntz"))
    conf = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        streamed = drain(stream.stream_new_flags(replay(with_flush(rows), "ts", files=2), cfg), "t3busy", tmp_path).where("user_id >= 0")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", conf)
    batch = features.new_item_days(sessions.activity_cells(rows), sessions.user_day_spine(rows), cfg)
    assert batch.count() > 0
    same(streamed, batch)


@pytest.fixture(scope="module")
def access_rows(inputs):
    events = inputs.events
    parts = [
        source.lease_grants(events).select("user_id", F.col("issued_at").alias("at"), F.col("issued_ord").alias("ord"),
                                           F.lit("grant").alias("kind"), "lease_id", "expires_at"),
        inputs.attempts.select("user_id", "at", F.col("attempt_id").alias("ord"), F.lit("redeem").alias("kind"), "lease_id"),
        inputs.revokes.select("user_id", "at", F.col("revoke_id").alias("ord"), F.lit("revoke").alias("kind"), "lease_id"),
        source.bulk_revokes(events).select("user_id", "at", F.col("bulk_id").alias("ord"), F.lit("bulk_revoke").alias("kind")),
        source.quarantine_events(events).select("user_id", "at", F.col("quarantine_id").alias("ord"),
                                                F.lit("quarantine").alias("kind")),
        source.resume_requests(events).select("user_id", "at", F.col("request_id").alias("ord"),
                                              F.lit("resume").alias("kind"), "approver"),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p, allowMissingColumns=True)
    return rows


def flushed(rows):
    """With a far later row of an extra user, so that the watermark passes all others."""
    return rows.unionByName(rows.limit(1).withColumns({"user_id": F.lit(-1).cast("bigint"), "at": F.lit(FLUSH).cast("timestamp_ntz"), "kind": F.lit("quarantine")}))


def equals_the_batch_ledger(out, inputs):
    same(out.where("kind = 'redeem'").select("ord", "outcome"),
         ledgers.redeem_outcomes(inputs.attempts, inputs.states).select(F.col("attempt_id").alias("ord"), "outcome"))
    same(out.where("kind = 'revoke'").select("ord", (F.col("outcome") == "revoked").alias("effective")),
         ledgers.revoke_outcomes(inputs.revokes, inputs.states).select(F.col("revoke_id").alias("ord"), "effective"))
    same(out.where("kind = 'bulk_revoke'").select("ord", "lease_id"),
         ledgers.bulk_revoked_leases(inputs.states).select(F.col("bulk_id").alias("ord"), "lease_id"))
    same(out.where("kind = 'resume'").select("ord", "outcome"),
         inputs.resumes.select(F.col("request_id").alias("ord"), "outcome"))
    ended = F.coalesce("redeemed.at", "revoked.at")  # a lease expires unless something ended it by then
    same(out.where("outcome = 'lease_expired'").select("lease_id"),
         inputs.states.where(ended.isNull() | (ended > F.col("expires_at"))).select("lease_id"))


def test_access_state(inputs, access_rows, replay, tmp_path):
    equals_the_batch_ledger(drain(stream_ledgers.stream_access(replay(flushed(access_rows), "at")), "t5", tmp_path), inputs)


def test_access_state_of_shuffled_rows(spark, inputs, access_rows, tmp_path):
    """Rows dealt over files at random, the watermark waiting for all of them."""
    folder = str(tmp_path / "in")
    for k in range(3):
        access_rows.where(F.pmod(F.xxhash64("ord"), F.lit(3)) == k).coalesce(1).write.mode("append").parquet(folder)
    flushed(access_rows).where("user_id = -1").coalesce(1).write.mode("append").parquet(folder)
    feed = spark.readStream.schema(access_rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    equals_the_batch_ledger(drain(stream_ledgers.stream_access(feed, delay="40 days"), "t5shuffled", tmp_path), inputs)


def test_access_state_forgets(spark, tmp_path):
    """A lease a day for 120 days, each redeemed: the state holds what retention asks for."""
    folder, start = str(tmp_path / "in"), dt.datetime(2024, 1, 1)
    schema = "user_id bigint, at timestamp_ntz, ord bigint, kind string, lease_id bigint, expires_at timestamp_ntz, approver string"
    for k in range(6):
        rows = []
        for d in range(20 * k, 20 * k + 20):
            at = start + dt.timedelta(days=d)
            rows += [(1, at, 3 * d, "grant", d, at + dt.timedelta(hours=2), None), (1, at + dt.timedelta(hours=1), 3 * d + 1, "redeem", d, None, None)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    late = start + dt.timedelta(days=150)
    spark.createDataFrame([(1, late, 900, "redeem", 149, None, None), (1, late, 901, "redeem", 100, None, None)], schema).coalesce(1).write.mode("append").parquet(folder)
    spark.createDataFrame([(2, late + dt.timedelta(days=1), 902, "quarantine", None, None, None)], schema).coalesce(1).write.mode("append").parquet(folder)
    feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    query = (stream_ledgers.stream_access(feed, retention_days=10).writeStream.format("memory").queryName("t5forget").outputMode("append")
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    query.awaitTermination(240)
    assert query.exception() is None
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(held) < 150  # a file's 40 rows wait, with an entry or two for each of the 10 to 30 leases kept
    out = {r.ord: r.outcome for r in spark.table("t5forget").where("ord IS NOT NULL").collect()}
    assert [out[3 * d + 1] for d in range(120)] == ["redeemed"] * 120 and out[900] == "unknown" and out[901] == "unknown"
