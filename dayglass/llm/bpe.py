"""Byte-pair encoding and decoding with a public vocabulary of words with ends.

A text is cut at special tokens, normalised (NFC, lower case) and split into words as the file
says. The bytes of a word are a doubly linked list of symbols; a priority queue holds the merge
rank and place of each pair of neighbours. The least entry is merged if it still describes its
place, else it is stale and skipped; a merge queues the two pairs it makes. A word takes
O(n log n) for n bytes, whatever its length, and a word met before is not merged again.

Decoding looks up each id's vocabulary string and concatenates them: with a space between, which is
what a file without a decoder asks for, or (`plain=True`) as bytes, word ends becoming spaces.

What counts as a letter, number or white space is asked of the tokenizers library once, on the
driver, as the versions of Unicode differ between libraries; so is the normal form of texts
beyond Latin-1. Merging and decoding are done here.

Defined results: null and empty texts have no ids and decode to the empty text, as null ids do;
ids outside the vocabulary are left out; repeated rows are encoded alike; columns named like the
results are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Memo, table, with_columns

MEMO_CHARS, MEMO_WORDS = 64, 200_000
PLACE = (1 << 32) - 1  # low bits of a queue entry: the place of the pair


@dataclass
class Vocabulary:
    """One tokenizer file, of fixed size: what encoding and decoding need of it."""
    inner: list[int]  # ids of the 256 bytes within a word
    last: list[int]  # and at its end
    ranks: dict[tuple[int, int], int]  # pair of ids to merge rank
    made: list[int]  # id that the merge of a rank makes
    spelled: list[str | None]  # vocabulary string by id
    special: dict[str, int]
    words: str  # pattern of a word
    narrow: str  # the same for texts of Latin-1 characters only, searched several times faster
    normal: object  # normaliser of the library
    end: str


def byte_characters() -> list[str]:
    """The character that stands for each byte in vocabulary strings: itself where it is printable
    Latin-1, else the next one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


def character_class(name: str, below: int = 0x110000) -> str:
    """The code points of a class such as `\\p{L}` as ranges, by the library's own judgement."""
    from tokenizers import Regex, pre_tokenizers

    every = "".join(map(chr, (c for c in range(below) if not 0xD800 <= c < 0xE000)))
    runs = pre_tokenizers.Split(Regex(f"{name}+"), "removed", invert=True).pre_tokenize_str(every)
    pieces, at = [], lambda c: f"\\U{ord(c):08x}"
    for run, _ in runs:
        if run[0] < "\ud800" < run[-1]:  # the string has no surrogates, a run may go across
            pieces.append(f"{at(run[0])}-\\ud7ff\\ue000-{at(run[-1])}")
        else:
            pieces.append(f"{at(run[0])}-{at(run[-1])}" if len(run) > 1 else at(run[0]))
    return "".join(pieces)


def load_vocabulary(path: str | None = None) -> Vocabulary:
    """The vocabulary of a tokenizer file; by default the public one of 49k words with ends."""
    import public_tokenizers as public
    from tokenizers import Tokenizer

    path = path or public.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as file:
        said = json.load(file)
    model, steps = said["model"], said["pre_tokenizer"].get("pretokenizers", [])
    if model["type"] != "BPE" or [s["type"] for s in steps] != ["Split", "ByteLevel"] or not steps[0]["invert"] or said["decoder"]:
        raise ValueError("not a byte-level BPE file with a word pattern and without a decoder")
    words = narrow = steps[0]["pattern"]["Regex"]
    for name in (r"\p{L}", r"\p{N}", r"\s"):  # all of them stand in brackets
        words, narrow = words.replace(name, character_class(name)), narrow.replace(name, character_class(name, 0x100))
    end, ids = model["end_of_word_suffix"] or "", model["vocab"]
    special = {t["content"]: t["id"] for t in said["added_tokens"]}
    spelled: list[str | None] = [None] * (max(*ids.values(), *special.values()) + 1)
    for piece, i in [*ids.items(), *special.items()]:
        spelled[i] = piece
    pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    signs = byte_characters()
    return Vocabulary([ids[c] for c in signs], [ids[c + end] for c in signs], {(ids[a], ids[b]): r for r, (a, b) in enumerate(pairs)},
                      [ids[a + b] for a, b in pairs], spelled, special, words, narrow, Tokenizer.from_file(path).normalizer, end)


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v, self.words, self.narrow = vocabulary, re.compile(vocabulary.words), re.compile(vocabulary.narrow)
        longest_first = sorted(vocabulary.special, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if longest_first else None
        self.memo = Memo(self.packed, MEMO_WORDS)

    def merge(self, symbols: list[int]) -> list[int]:
        """The symbols left when no pair of neighbours has a merge, always merging the pair of
        least rank, the leftmost of several."""
        ranks, made, n = self.v.ranks, self.v.made, len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []
        for place, pair in enumerate(zip(symbols, symbols[1:])):
            rank = ranks.get(pair)
            if rank is not None:
                queue.append(rank << 32 | place)
        heapq.heapify(queue)
        while queue:
            entry = heapq.heappop(queue)
            rank, left = entry >> 32, entry & PLACE
            right = after[left]
            if right == n or symbols[left] < 0 or ranks.get((symbols[left], symbols[right])) != rank:
                continue  # stale: one of the two has been merged since
            symbol = symbols[left] = made[rank]
            symbols[right] = -1
            following = after[left] = after[right]
            if following < n:
                before[following] = left
                rank = ranks.get((symbol, symbols[following]))
                if rank is not None:
                    heapq.heappush(queue, rank << 32 | left)
            previous = before[left]
            if previous >= 0:
                rank = ranks.get((symbols[previous], symbol))
                if rank is not None:
                    heapq.heappush(queue, rank << 32 | previous)
        return [s for s in symbols if s >= 0]

    def packed(self, word: str) -> bytes:
        """Ids of a word as int32."""
        data = word.encode()
        symbols = [*map(self.v.inner.__getitem__, data[:-1]), self.v.last[data[-1]]]
        return np.array(self.merge(symbols), np.int32).tobytes()

    def split(self, text: str) -> list[str]:
        """The words of a text in normal form."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.words.findall(self.v.normal.normalize_str(text))
        return self.narrow.findall(text.lower())  # NFC already; white space separates words whichever it is

    def encode(self, text: str) -> bytes:
        """Ids of a text as int32."""
        found, memo = [], self.memo
        for k, part in enumerate(self.special.split(text) if self.special else [text]):
            if k % 2:
                found.append(np.int32(self.v.special[part]).tobytes())
            else:
                found += [memo[w] if len(w) <= MEMO_CHARS else self.packed(w) for w in self.split(part)]
        return b"".join(found)


def encode(docs: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """`docs` with ids and n_tokens of the whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary or load_vocabulary())  # one tokenizer file

    def work(batch: pa.RecordBatch, encoder: Encoder) -> list:
        found = [encoder.encode(x or "") for x in batch["text"].to_pylist()]
        sizes = [len(x) // 4 for x in found]
        ids = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(np.frombuffer(b"".join(found), np.int32)))
        return [ids, sizes]

    return with_columns(docs, "ids array<int>, n_tokens long", work, lambda: Encoder(shared.value))


def decode(encoded: DataFrame, vocabulary: Vocabulary | None = None, plain: bool = False) -> DataFrame:
    """`encoded` with decoded: the vocabulary strings of its ids with a space between, or with
    `plain` the bytes they stand for, each word followed by a space."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary or load_vocabulary())

    def setup() -> tuple[list, object]:
        v = shared.value
        if not plain:
            return v.spelled, lambda pieces: " ".join(pieces)
        byte_of = {c: bytes([b]) for b, c in enumerate(byte_characters())}
        special = set(v.special.values())

        def bytes_of(i: int, piece: str) -> bytes:
            if i in special:
                return piece.encode()
            ends = bool(v.end) and piece.endswith(v.end)
            return b"".join(map(byte_of.__getitem__, piece[:-len(v.end)] if ends else piece)) + b" " * ends

        spelled = [p if p is None else bytes_of(i, p) for i, p in enumerate(v.spelled)]
        return spelled, lambda pieces: b"".join(pieces).decode(errors="replace")

    def work(batch: pa.RecordBatch, state: tuple) -> list:
        spelled, join = state
        every = batch["ids"].values.to_numpy(zero_copy_only=False)  # one text at a time becomes Python numbers
        offsets, null = batch["ids"].offsets.to_numpy(), batch["ids"].is_null().to_numpy(zero_copy_only=False)
        ends = np.where(null, offsets[:-1], offsets[1:]).tolist()
        texts = []
        for a, b in zip(offsets[:-1].tolist(), ends):
            ids = every[a:b]
            if b > a and not (ids.dtype.kind == "i" and 0 <= ids.min() and ids.max() < len(spelled)):  # a null entry makes floats
                ids = ids[(ids >= 0) & (ids < len(spelled))].astype(np.int64)
            pieces = [spelled[i] for i in ids.tolist()]
            texts.append(join(pieces if None not in pieces else [p for p in pieces if p is not None]))
        return [texts]

    return with_columns(encoded, "decoded string", work, setup)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = decode(encode(table(spark, sf_dir, "documents").select("doc_id", "text")))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return back.select("doc_id", "n_tokens", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
