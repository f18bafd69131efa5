import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from dayglass.operators import audit
from dayglass.sources import audit_files, logs
from dayglass.sources.schemas import DIRECTORY_SCHEMA, LOG_SCHEMAS


@pytest.fixture(scope="module")
def chained(inputs):
    from dayglass.session import materialize

    return materialize(inputs.chained, "chained")


def rows_by_chain(df):
    out = {}
    for r in df.orderBy("chain_id", "seq").collect():
        out.setdefault(r.chain_id, []).append(r)
    return out


def test_chain_against_hashlib(chained):
    """An independent reader needs only JSON and SHA-256."""
    for rows in rows_by_chain(chained).values():
        prev = "0" * 64
        for i, r in enumerate(rows):
            body = {"event_type": r.event_type, "payload": json.loads(r.payload), "prev_hash": prev, "seq": i, "timestamp": r.event_time}
            text = json.dumps(body, sort_keys=True, separators=(",", ":"))
            assert r.seq == i and r.prev_hash == prev and r.entry_hash == hashlib.sha256(text.encode()).hexdigest()
            prev = r.entry_hash


def test_intact_log_verifies(chained):
    row = audit.verify_summary(audit.verify(chained)).first()
    assert row.total == row.verified == chained.count() and row.flagged == 0
    assert audit.verify_entries(chained).where("NOT ok").count() == 0
    assert audit.verify_heads(chained, audit.chain_heads(chained)).where("NOT ok").count() == 0


def flagged(df, order="pos"):
    return {(r.chain_id, r.seq): r.error for r in audit.verify(df, order).where("NOT ok").collect()}


def test_drills(chained):
    sizes = {c: len(r) for c, r in rows_by_chain(chained).items()}
    middle = {c: n // 2 for c, n in sizes.items()}
    assert flagged(audit.tamper(chained, "edit")) == {(c, m): "hash mismatch" for c, m in middle.items()}
    assert flagged(audit.tamper(chained, "delete")) == {(c, m + 1): "chain break" for c, m in middle.items() if m + 1 < sizes[c]}
    assert flagged(audit.tamper(chained, "insert")) == {(c, m): "chain break" for c, m in middle.items()}
    swapped = {(c, s): "chain break" for c, m in middle.items() if m for s in (m - 1, m, m + 1) if s < sizes[c]}
    assert flagged(audit.tamper(chained, "reorder")) == swapped
    # an edit whose own hash was recomputed breaks the link after it
    forged = audit.tamper(chained, "edit").withColumn("entry_hash", F.sha2(audit.canonical_entry(), 256))
    assert flagged(forged) == {(c, m + 1): "chain break" for c, m in middle.items() if m + 1 < sizes[c]}


def test_cut_tail_shows_in_heads_only(chained):
    heads = audit.chain_heads(chained)
    last = chained.groupBy("chain_id").agg(F.max("seq").alias("last"))
    cut = chained.join(last, "chain_id").where("seq < last").drop("last")
    assert audit.verify(cut).where("NOT ok").count() == 0
    assert audit.verify_heads(cut, heads).where("NOT ok").count() == heads.count()


def test_heads_form_a_chain(chained):
    top = audit.chain_the_heads(audit.chain_heads(chained))
    assert audit.verify(top).where("NOT ok").count() == 0


def test_escaping_of_odd_text(spark):
    rows = [("c", 0, "2024-01-01 00:00:00", 'quote " back \\ line \n', '{"user":"é"}')]
    made = audit.build_chains(spark.createDataFrame(rows, "chain_id string, seq bigint, event_time string, event_type string, payload string"))
    assert audit.verify(made).first().ok


def test_chain_longer_than_an_arrow_batch(spark):
    made = audit.build_chains(spark.range(25_000).select(
        F.lit("c").alias("chain_id"), F.col("id").alias("seq"), F.lit("t").alias("event_time"), F.lit("e").alias("event_type"),
        F.lit("{}").alias("payload")))
    row = audit.verify_summary(audit.verify(made)).first()
    assert (row.total, row.flagged) == (25_000, 0)


def test_file_round_trip(spark, chained, tmp_path):
    folder = str(tmp_path / "log")
    audit_files.write_audit(chained, folder)
    part = next((tmp_path / "log").glob("chain_id=*/part-*.json"))
    lines = part.read_text().splitlines()
    assert all(list(json.loads(x)) == sorted(json.loads(x)) for x in lines)
    part.write_text("\n" + part.read_text() + "\n\n")  # blank lines are skipped
    (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    again = audit_files.read_audit(spark, folder)
    assert again.where("bad_line IS NOT NULL").count() == 0
    again = again.drop("bad_line")
    assert again.exceptAll(chained.select(*again.columns)).count() == 0 and again.count() == chained.count()
    assert audit.verify(again).where("NOT ok").count() == 0


@pytest.mark.parametrize("place", [0, 1, -1])
def test_damaged_line_is_flagged(spark, chained, tmp_path, place):
    folder = str(tmp_path / "log")
    audit_files.write_audit(chained, folder)
    part = next(p for p in sorted((tmp_path / "log").glob("chain_id=*/part-*.json")) if len(p.read_text().splitlines()) > 2)
    lines = part.read_text().splitlines()
    lines[place] = lines[place][:len(lines[place]) // 2]
    part.write_text("\n".join(lines) + "\n")
    (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    again = audit_files.read_audit(spark, folder)
    assert [r.bad_line for r in again.where("bad_line IS NOT NULL").collect()] == [lines[place]]
    bad = audit.verify(again).where("NOT ok").collect()
    # the line itself, and the entry whose link leads to it, if there is one
    assert sorted(r.error for r in bad) == (["unreadable"] if place == -1 else ["chain break", "unreadable"])
    assert audit.verify_summary(audit.verify(again)).first().total == chained.count()
    assert audit.verify_heads(again, audit.chain_heads(chained)).where("NOT ok").count() == int(place == -1)


def test_search_and_pick(chained):
    hits = audit.search(chained, "STEPUP").collect()
    assert 0 < len(hits) <= 100 and all("stepup" in r.event_type for r in hits)
    user = json.loads(chained.first().payload)["user"]
    assert all(user in json.loads(r.payload)["user"] or user in r.event_type for r in audit.search(chained, user).collect())
    assert len(audit.search(chained).collect()) == 30
    assert audit.pick_entry(chained).first().seq == 0  # no Critical session at this scale: the first entry
    assert audit.pick_entry(chained.where("false")).count() == 0


# ---- csv logs ------------------------------------------------------------------------------
def test_csv_layout(spark, tmp_path):
    text = {
        "logon": "date,user,pc,activity\n2026-01-05 08:00:00,ann,p1,Logon\nnot a date,ann,p1,Logon\n",
        "device": "date,user,pc,activity,device_id\n2026-01-05 09:00:00,ann,p1,Connect,u1\n",
        "file": "date,user,pc,filename,activity,size_mb,to_removable_media\n2026-01-05 09:30:00,ann,p1,f,Copy,2.5,true\n",
        "http": "date,user,pc,url,domain,category,upload_mb\n",
        "email": "date,user,pc,to_domain_type,size_mb,attachments\n2026-01-05 10:00:00,ann,p1,external,1.0,2\n",
    }
    for name, body in text.items():
        (tmp_path / f"{name}.csv").write_text(body)
    frames = logs.read_logs(spark, str(tmp_path))
    assert all([(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in LOG_SCHEMAS[n]] for n, df in frames.items())
    activity = logs.unify_logs(frames)
    assert activity.count() == 4
    bad = logs.read_table(spark, str(tmp_path / "logon.csv"), LOG_SCHEMAS["logon"], keep_bad_rows=True)
    assert [bool(r[logs.BAD_ROW]) for r in bad.collect()] == [False, True]
    rejects = logs.read_log_rejects(spark, str(tmp_path)).collect()
    assert [(r.source, r.reason, r.line) for r in rejects] == [("logon", "unparsable", "not a date,ann,p1,Logon")]


def test_rows_without_a_key_are_rejects(spark, tmp_path):
    (tmp_path / "logon.csv").write_text("date,user,pc,activity\n,ann,p1,Logon\n2026-01-05 08:00:00,ann,p1,Logon\n")
    (row,) = logs.read_rejects(spark, str(tmp_path / "logon.csv"), LOG_SCHEMAS["logon"]).collect()
    assert row.reason == "no key" and json.loads(row.line)["user"] == "ann"


def test_directory_keeps_the_latest_hired(spark, tmp_path):
    body = "user,role,hire_date,is_night_shift\n"
    rows = ["ann,DBA,2020-01-01 00:00:00,false", "ann,SOC,2021-01-01 00:00:00,true", "ann,DEV,2021-01-01 00:00:00,false", "bob,DBA,,false"]
    for order in (rows, rows[::-1]):
        (tmp_path / "d.csv").write_text(body + "\n".join(order) + "\n")
        found = {r.user_id: (r.role, r.is_night_shift) for r in logs.read_directory(spark, str(tmp_path / "d.csv")).collect()}
        assert found == {"ann": ("SOC", True), "bob": ("DBA", False)}


def test_directory_and_answers(spark, tmp_path):
    (tmp_path / "d.csv").write_text("user,role,hire_date,is_night_shift\nann,DBA,2020-01-01 00:00:00,false\n")
    (tmp_path / "a.csv").write_text("user,role,scenario_id,date\nann,DBA,S2,2026-01-05 10:00:00\nann,DBA,S1,2026-01-05 11:00:00\n")
    row = logs.read_directory(spark, str(tmp_path / "d.csv")).first()
    assert (row.user_id, row.role, row.is_night_shift) == ("ann", "DBA", False)
    answers = logs.read_answers(spark, str(tmp_path / "a.csv")).collect()
    assert [(r.user_id, r.day, r.scenario_id) for r in answers] == [("ann", dt.date(2026, 1, 5), "S1")]
    assert DIRECTORY_SCHEMA.names[0] == "user"


def test_heads_are_chained_by_day_and_days_in_turn(chained):
    top = audit.chain_the_heads(audit.chain_heads(chained)).collect()
    days = {r.chain_id.split("/")[0] for r in chained.select("chain_id").distinct().collect()}
    assert {r.chain_id for r in top} == {f"heads/{d}" for d in days} | {"days"}
    assert [r.event_time for r in sorted((r for r in top if r.chain_id == "days"), key=lambda r: r.seq)] == sorted(days)
    assert sum(r.chain_id != "days" for r in top) == chained.select("chain_id").distinct().count()
