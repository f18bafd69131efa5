"""Ledgers that repeat, roles that hold control strings, long rule lists, the forest's recall, units searched together,
id ranges that the driver places without their ids."""

import hashlib
import math
import random
import re
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyspark
import pytest
from pyspark.sql import functions as F

from dayglass.llm import chat_format, common, fingerprints, jaccard_join, lm_scores, pieces, secret_scans, toxicity, url_filters


# ---- secret scans
def test_repeated_and_overlapping_scans_count_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, "token=abcdefgh1"), (2, "nothing"), (3, "0" * 40 + " secret: abcdefgh2")], "doc_id long, text string")
    want = [(r.doc_id, r.found) for r in secret_scans.with_findings(docs, secret_scans.update_ledger(docs, str(tmp_path / "one"))).orderBy("doc_id").collect()]
    path = str(tmp_path / "two")
    for scan in ("a", "a", "b"):  # a is repeated; then b finds nothing left to do
        ledger = secret_scans.update_ledger(docs, path, scan=scan)
        assert ledger.groupBy("blob", "rule", "version").count().where("count > 1").count() == 0
    twice = ledger.unionByName(ledger)  # two scans at once: both hold every pair
    for held in (ledger, twice):
        assert [(r.doc_id, r.found) for r in secret_scans.with_findings(docs, held).orderBy("doc_id").collect()] == want
    assert want[0][1] and want[2][1]


# ---- chat formatting
ROLES = ["user", "a\nb", "<|im_end|>", "<|nl|>\n", "<|\\nl|>", "assistant", "", "\n\n", "<|im_start|>assistant\nok"]


def test_any_role_can_be_read_back(spark):
    for role in ROLES:
        written = chat_format.escape_role(role)
        assert "\n" not in written and chat_format.END not in written and chat_format.START not in written
        assert chat_format.unescape_role(written) == role
    turns = spark.createDataFrame([(1, k, r, f"text {k}\n<|nl|>") for k, r in enumerate(ROLES)], "conv_id long, turn long, role string, text string")
    got = chat_format.read_back(chat_format.assemble(chat_format.format_turns(turns))).first()
    plain = "".join(f"{r}\ntext {k}\n<|nl|>\n" for k, r in enumerate(ROLES))
    assert got.turns_sha256 == hashlib.sha256(plain.encode()).hexdigest() and got.n_turns == len(ROLES)


# ---- URL filters
def test_long_lists_join_by_folder_and_agree_with_the_trie(spark):
    rng = random.Random(2)
    part = lambda: rng.choice(["a", "b", "ab", "", "c"])
    path = lambda: rng.choice(["", "/".join(["", *(part() for _ in range(rng.randint(0, 3)))])])
    hosts = ["x.org", "org", "b.x.org", "net", "y.net"]
    rules = [(rng.choice(["allow", "block"]), rng.choice([*hosts, None]), rng.choice([path(), None])) for _ in range(60)]
    urls = [(k, rng.choice(["http://", "", "x://"]) + rng.choice([*hosts, "q.b.x.org", ""]) + path() + rng.choice(["", "?a/b", "#c"])) for k in range(300)] + [(999, None)]
    frame = spark.createDataFrame(rules, "verdict string, host string, path string")
    pages = spark.createDataFrame(urls, "page_id long, url string").withColumns({c: F.lit("x") for c in ("host", "path", "rule", "verdict", "_s", "_d")})
    short, long = (sorted(map(tuple, url_filters.judge(pages, frame, trie_bytes=n).select("page_id", "host", "path", "rule", "verdict").collect())) for n in (1 << 20, 0))
    assert short == long and any(r[3] for r in short)
    plan = url_filters._judge_by_join(pages, frame.na.fill(""), "allow")._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"_d#\d+ = _f#\d+", plan) and re.search(r"_s#\d+ = _h#\d+", plan)


# ---- the filter of ids
def test_filter_holds_all_its_ids_and_few_others(spark):
    inside, outside = spark.range(0, 20000, 4), spark.range(1, 20000, 4)
    words = common.id_filter(inside.select(F.xxhash64("id").alias("_h")))
    hold = lambda ids: common.may_hold(words, np.array([r.h for r in ids.select(F.xxhash64("id").alias("h")).collect()], np.int64))
    assert hold(inside).all() and hold(outside).mean() < 0.05
    assert not common.may_hold(common.id_filter(spark.range(0).select(F.xxhash64("id").alias("_h"))), np.array([1, 2], np.int64)).any()


def test_toxicity_moves_labelled_texts_only(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    labels = spark.range(0, 3000, 30).select(F.col("id").alias("doc_id"), (F.col("id") % 60 == 0).cast("int").alias("toxic"))
    rows = toxicity.training_rows(docs, labels).collect()
    ids = {int(r.text.split()[1]): r.toxic for r in rows}
    want = {r.doc_id: r.toxic for r in labels.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1).collect()}
    assert ids == want


# ---- forest
def test_recall_of_pairs_at_the_threshold(spark):
    rng = random.Random(7)
    rows = []
    for g in range(400):  # 5-word shingles: one changed word of n costs five of n - 4
        words = [f"{rng.randrange(10 ** 6):x}" for _ in range(49)]  # 45 shingles: 40 of 50 are common, 0.8 exactly
        other = list(words)
        other[rng.randrange(5, 44)] = "changed"
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(other))]
    got = {r.doc_id: r for r in jaccard_join.classify(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    met = sum(got[2 * g + 1].class_id == 2 * g and got[2 * g].n_links == 1 for g in range(400))
    assert met >= 0.99 * 400


def test_large_groups_stop_early_and_lose_no_link(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(10 ** 5)}" for _ in range(300)]
    rows = [(k, " ".join([*base, *(f"t{k}x{j}" for j in range(3))])) for k in range(150)]  # all alike but for the end
    got = jaccard_join.classify(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.class_id == 0 and r.n_links == 149 for r in got)


def test_meetings_are_unique():
    rng = np.random.default_rng(1)
    labels = rng.integers(0, 256, (40, 6, 8), dtype=np.uint8)
    for k in range(1, 40):  # long common prefixes with the first rows
        for t in range(6):
            n = int(rng.integers(0, 9))
            labels[k, t, :n] = labels[k // 4, t, :n]
    packed = np.ascontiguousarray(labels).view(">u8").astype(np.uint64).reshape(40, 6)
    a, b = np.triu_indices(40, 1)
    found = np.stack([jaccard_join.met_at(packed, a, b, t, 5) for t in range(6)], axis=1)
    for i, j, row in zip(a, b, found):
        lengths = [next((n for n in range(8) if labels[i, t, n] != labels[j, t, n]), 8) for t in range(6)]
        best = max(lengths)
        want = [0] * 6
        if best >= 5:
            want[lengths.index(best)] = best
        assert row.tolist() == want


# ---- LM scores
def test_runs_survive_packing():
    rng = np.random.default_rng(3)
    for n in (0, 1, 7, 5000):
        keys = np.unique(rng.integers(0, 2 ** 48, n))
        assert (lm_scores.unpacked_keys(lm_scores.GRAMS, lm_scores.packed_keys(lm_scores.GRAMS, keys)) == keys).all()
        values = rng.normal(size=n)
        assert (lm_scores.unpacked(lm_scores.packed(values), np.float64) == values).all()
        if n:
            index = lm_scores.Index(keys[::-1].copy(), np.arange(len(keys))[::-1].copy())
            some = rng.integers(0, len(keys), 100)
            assert (index[keys[some]] == some).all()
    for words in ([b""], [b"", b"a"], [b"b", b"", b"\xff"]):
        assert lm_scores.unpacked_keys(lm_scores.WORDS, lm_scores.packed_keys(lm_scores.WORDS, words)) == words


def traced_peak(work) -> int:
    """Bytes that `work` held at most at a time."""
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_a_block_holds_few_bytes_for_each_byte_of_text(spark, monkeypatch):
    rng = np.random.default_rng(5)
    vocabulary = np.array(["".join(map(chr, 97 + rng.integers(0, 26, n))) for n in rng.integers(3, 10, 3000)])
    texts = [" ".join(vocabulary[rng.integers(0, 3000, 300)]).encode() for _ in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array([k % 7 != 2 for k in range(1000)]), pa.array(texts)], ["doc_id", "train", "text"])
    monkeypatch.setattr(lm_scores, "map_columns", lambda rows, schema, work: work)
    monkeypatch.setattr(pyspark.TaskContext, "get", classmethod(lambda cls: SimpleNamespace(partitionId=lambda: 0)))
    monkeypatch.setattr(lm_scores, "SLICE_WINDOWS", 1 << 17)
    work, kinds = lm_scores.packed_blocks(spark.createDataFrame([(1, "")], "doc_id long, text string"), 16), Counter()

    def read():
        for columns in work([batch]):
            kinds.update(columns[0])

    peak = traced_peak(read)
    assert kinds[lm_scores.GRAMS] == kinds[lm_scores.WORDS] == 16 and kinds[lm_scores.TEXTS] > 10
    assert peak < 16 * sum(map(len, texts)), peak / sum(map(len, texts))


@pytest.mark.parametrize("slices", [1, 5])
def test_blocks_count_as_plain_counters(monkeypatch, slices):
    monkeypatch.setattr(lm_scores, "SLICE_WINDOWS", 4000 // slices)
    rng, block = random.Random(6), lm_scores.Block(37)
    texts = ["".join(rng.choices("abC \u00e9", k=rng.randint(0, 60))).encode() for _ in range(100)] + [b"a" * 900, b""]
    train = [rng.random() < 0.6 for _ in texts]
    for rows in lm_scores.slices(pa.table([pa.array(range(len(texts))), pa.array(train), pa.array(texts)], schema=lm_scores.TEXT)):
        block.add(rows)
    want = {lm_scores.GRAMS: Counter(), lm_scores.WORDS: Counter()}
    for text, learned in zip(texts, train):
        data = bytes([lm_scores.START]) * lm_scores.ORDER + text.lower() + bytes([lm_scores.END])
        for i in range(lm_scores.ORDER, len(data)):
            want[lm_scores.GRAMS][int.from_bytes(data[i - lm_scores.ORDER:i + 1], "big")] += learned
        for word in [*text.lower().split(), b""]:
            want[lm_scores.WORDS][word] += learned
    got, places = {lm_scores.GRAMS: {}, lm_scores.WORDS: {}}, set()
    for kind, bucket, keys, numbers in block.runs():
        assert (kind, bucket) not in places
        places.add((kind, bucket))
        keys = lm_scores.unpacked_keys(kind, keys)
        if kind == lm_scores.GRAMS:
            assert (np.diff(keys) > 0).all() and (lm_scores.gram_buckets(keys, 37) == bucket).all()
            keys = keys.tolist()
        assert not set(keys) & set(got[kind])
        got[kind].update(zip(keys, lm_scores.unpacked(numbers).tolist()))
    assert got == want


def test_runs_are_read_one_at_a_time():
    rows = [(lm_scores.GRAMS, k // 10, bytes(100_000), b"x") for k in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["kind", "bucket", "keys", "numbers"])

    def read():
        assert [sum(len(keys) for keys, _ in own) for _, _, own in lm_scores.by_bucket([batch], ("keys", "numbers"))] == [1_000_000] * 6

    assert traced_peak(read) < 1_000_000


@pytest.mark.parametrize("buckets", [1, 16, 153])
def test_buckets_of_columns_and_arrays_agree(spark, buckets):
    grams = np.random.default_rng(4).integers(0, 2 ** 48, 500)
    frame = spark.createDataFrame([(int(g),) for g in grams], "gram long")
    assert [r.b for r in frame.select(lm_scores.gram_bucket(F.col("gram"), buckets).alias("b")).collect()] == lm_scores.gram_buckets(grams, buckets).tolist()


# ---- pieces
def one_at_a_time(encoder, text):
    found = [encoder.segment(x) for x in encoder.units(text)]
    return [i for ids, _ in found for i in ids.tolist()], math.fsum(score for _, score in found)


def test_short_units_are_searched_together(monkeypatch):
    vocabulary, rng = pieces.load_vocabulary(), random.Random(5)
    words = ["".join(rng.choices("aeinorst\n.é🎉▁", k=rng.randint(1, 12))) for _ in range(3000)]
    texts = [" ".join(words[k:k + 100]) for k in range(0, 3000, 100)]
    plain = pieces.Encoder(vocabulary)
    want = [one_at_a_time(plain, x) for x in texts]

    def alone(self, unit):
        raise AssertionError(unit)

    monkeypatch.setattr(pieces.Encoder, "segment", alone)
    encoder = pieces.Encoder(vocabulary)
    assert [(ids.tolist(), score) for ids, score in map(encoder.encode, texts)] == want


@pytest.mark.parametrize("kept", [0, 7, 100_000])
def test_units_together_equal_one_at_a_time_whatever_is_kept(monkeypatch, kept):
    monkeypatch.setattr(pieces, "MEMO_UNITS", kept)
    monkeypatch.setattr(pieces, "TOGETHER", 50)
    monkeypatch.setattr(pieces, "GROUP_CHARS", 200)
    rng = random.Random(6)
    texts = ["", " ", "   ", "▁", " a", "a ", "a  b", "▁ ▁▁", "é" * 70, "x" * 63, "x" * 64, " " * 70 + "y", "🎉\x00\n\t", "same same same"]
    texts += ["".join(rng.choices("aeth n▁é🎉\n.", k=rng.randint(1, 120))) for _ in range(300)] * 2
    encoder = pieces.Encoder(pieces.load_vocabulary())
    got = []
    for group in pieces.groups(texts):
        ids, sizes, scores = encoder.encode_texts(group)
        ends = np.cumsum([0, *sizes]).tolist()
        got += [(ids[a:b].tolist(), score) for a, b, score in zip(ends, ends[1:], scores)]
        assert len(encoder.slots) == len(encoder.sizes) == len(encoder.scores) <= kept and not encoder.slots.passing and len(encoder.ids) == sum(encoder.sizes)
    assert got == [one_at_a_time(encoder, x) for x in texts]


# ---- fingerprints
def id_table(spark, n):
    """Ids from -7 in steps of 3, hashed over the partitions; -7 and one in the middle are there 300 times, null 40 times."""
    ids = spark.range(n).select((F.col("id") * 3 - 7).alias("doc_id"))
    more = spark.range(640).select(F.when(F.col("id") < 300, -7).when(F.col("id") < 600, 3 * (n // 2) - 7).cast("long").alias("doc_id"))
    return ids.unionByName(more).repartition(6, F.xxhash64("doc_id"))


@pytest.mark.parametrize("sorted_by_a_task", [1 << 20, 1 << 11])
def test_only_the_starts_of_id_ranges_reach_the_driver(spark, monkeypatch, sorted_by_a_task):
    monkeypatch.setattr(fingerprints, "SORT_IDS", sorted_by_a_task, raising=False)
    ids, fetched = id_table(spark, 20_000), []
    collect = type(ids).collect

    def counted(frame):
        rows = collect(frame)
        fetched.append(len(rows))
        return rows

    monkeypatch.setattr(type(ids), "collect", counted)
    starts = fingerprints.range_starts(ids, 500)
    assert max(fetched) < 100
    monkeypatch.undo()
    assert starts[0] == -7 and starts == sorted(set(starts))
    held = {r.r: r["count"] for r in ids.groupBy(fingerprints.range_of(F.col("doc_id"), starts).alias("r")).count().collect()}
    assert held.pop(0) == 40 and sorted(held) == list(range(1, len(starts) + 1))
    assert max(held.values()) <= 500 + 300 and sum(held.values()) == 20_600


def test_ranges_grow_beyond_their_greatest_number(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGES", 8)
    starts = fingerprints.range_starts(id_table(spark, 5000), 2)
    assert starts[0] == -7 and 6 <= len(starts) <= 9
    assert fingerprints.range_starts(spark.createDataFrame([(None,)], "doc_id long"), 2) == []


def test_starts_are_one_value_of_the_plan(spark):
    """They were cast from text again for each row, within a lambda."""
    starts = list(range(0, 4000, 2))
    ids = spark.createDataFrame([(None,), (-1,), (0,), (1,), (3998,), (9999,)], "doc_id long").repartition(2)
    found = ids.select("doc_id", fingerprints.range_of(F.col("doc_id"), starts).alias("r"))
    assert "transform(" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {x.doc_id: x.r for x in found.collect()} == {None: 0, -1: 0, 0: 1, 1: 1, 3998: 2000, 9999: 2000}
