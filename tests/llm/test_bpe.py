"""Byte-pair encoding against the tokenizers library, text for text."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from dayglass.llm import bpe

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"
ODD = ["", "  \n\t ", "İΣ ΑΣ ς", "ȩ́ é ạ̊", "ab<|endoftext|>c<|startoftext|><|endoftext|", "<|EndOfText|>", "x" * 30000, "lorem ipsum " * 5000,
       "don't WE'LL i'm 'sx 12²③", "a\x00b\x1c\x85 ﻿￾", "日本語テキスト 한국어", "\U0001f468‍\U0001f469 \U0001e900"]


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.load_vocabulary()


@pytest.fixture(scope="module")
def library():
    import public_tokenizers as public
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    found.no_truncation()
    found.no_padding()
    return found


def ids_of(library, text):
    return library.encode(text, add_special_tokens=False).ids


def test_any_text_has_the_ids_of_the_library(vocabulary, library):
    rng, encoder = random.Random(5), bpe.Encoder(vocabulary)
    every = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(map(chr, every[at:at + 64])) for at in range(0, len(every), 64)]
    texts += ["".join(chr(rng.choice(every)) if rng.random() < 0.3 else rng.choice("aeΣσé'stllreve 12  \x1c\x85́İ<|>") for _ in range(80)) for _ in range(3000)]
    texts += ["".join(rng.choice("abcdefghij ") for _ in range(300)) for _ in range(300)] + ODD
    for text, encoded in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert list(memoryview(encoder.encode(text)).cast("i")) == encoded.ids


def test_merges_equal_repeated_search_of_the_least_rank(vocabulary):
    rng, encoder = random.Random(6), bpe.Encoder(vocabulary)
    for _ in range(300):
        data = bytes(rng.choice(b"aabbcdeinrst") for _ in range(rng.randint(1, 40)))
        symbols = [*(vocabulary.inner[b] for b in data[:-1]), vocabulary.last[data[-1]]]
        want = list(symbols)
        while True:
            ranked = [(vocabulary.ranks[p], k) for k, p in enumerate(zip(want, want[1:])) if p in vocabulary.ranks]
            if not ranked:
                break
            rank, k = min(ranked)
            want[k:k + 2] = [vocabulary.made[rank]]
        assert encoder.merge(symbols) == want


def test_query_equals_the_library_on_a_whole_table(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = bpe.query(spark, SF).collect()
    assert len(rows) == len(texts)
    for row in rows:
        ids = ids_of(library, texts[row.doc_id])
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))]
        assert [row.n_tokens, row.ids_sha256, row.decoded_sha256] == [len(ids), *digests]


def test_odd_rows(spark, vocabulary, library):
    rows = [(k, t) for k, t in enumerate(ODD)] * 2 + [(None, "no id"), (99, None)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("ids", "n_tokens", "decoded", "label")})
    back = bpe.decode(bpe.encode(docs, vocabulary), vocabulary).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.text) for r in back if r.doc_id is not None) == sorted((k is None, k, t) for k, t in rows if k is not None)
    for r in back:
        assert r.ids == ids_of(library, r.text or "") and r.n_tokens == len(r.ids) and r.label == "x"
        assert r.decoded == library.decode(r.ids, skip_special_tokens=False)
    none = bpe.decode(bpe.encode(spark.createDataFrame([], SCHEMA), vocabulary), vocabulary)
    assert none.columns == ["doc_id", "text", "ids", "n_tokens", "decoded"] and none.count() == 0


def test_decoding_of_any_ids(spark, vocabulary, library):
    ids = [([49406, 320, 1125, 49407],), (None,), ([],), ([-1, 320, 10 ** 6, None, 539],), ([256 + 3],)]
    got = [r.decoded for r in bpe.decode(spark.createDataFrame(ids, "ids array<int>").coalesce(1), vocabulary).collect()]
    assert got == [library.decode([i for i in (x or []) if i is not None and 0 <= i < 49408], skip_special_tokens=False) for x, in ids]
    docs = spark.createDataFrame([("Grüße, Welt<|endoftext|> 日本",)], "text string")
    plain = bpe.decode(bpe.encode(docs, vocabulary), vocabulary, plain=True).first().decoded
    assert plain == "grüße , welt <|endoftext|>日本 "


def test_other_files_are_refused():
    import public_tokenizers as public

    with pytest.raises(ValueError):
        bpe.load_vocabulary(public.path("byte_bpe_50k.json"))
