"""SentencePiece encoding and decoding over a public piece vocabulary.

An Aho-Corasick automaton over all pieces reads a text once; at each position it follows its
output links to every piece that ends there, and each relaxes the best score of the position
(Viterbi). No piece crosses from a character into a word-start mark, so a text falls into units
at such places. The frequent units of a worker are searched once; thousands of others take each
step of the search together, as arrays. Long units are searched one at a time.

The file at hand holds merge ranks instead of log probabilities; `zipf` scores make a piece of
rank r cost ln((r + 1) H) with H the harmonic sum of the vocabulary. For a file with log
probabilities use `scores="model"`. Ties go to the longer last piece.

The round trip is exact for every text: characters without a piece, and the word-start mark
itself where a text holds it, are written as byte pieces.

Defined results: null and empty texts have no pieces, score 0 and decode to the empty text;
repeated rows are encoded alike; a text without spaces is one unit, whatever its length; columns
named like the results are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain, islice

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table, with_columns

SPACE = "▁"
LITERAL = "\ud800"  # stands for a mark that the text itself holds; no text has lone surrogates
UNIT = re.compile(" ( *[^ ]*)")
UNIT_CHARS = 64  # shorter units go together and may be kept, longer ones one at a time
MEMO_UNITS = 200_000
TOGETHER = 8192  # units that take a step at a time
GROUP_CHARS = 1 << 20  # of texts whose units are looked up at a time


@dataclass
class Vocabulary:
    """Pieces by id: (piece, log score) for normal ones; ids of the 256 byte pieces."""
    pieces: list[tuple[str, float] | None]
    bytes_: list[int]

    @property
    def fallback(self) -> float:
        return min(p[1] for p in self.pieces if p) - 10.0


def load_vocabulary(path: str | None = None, scores: str = "zipf") -> Vocabulary:
    """The vocabulary of a model file; by default the public 32k one."""
    import public_tokenizers as public
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public.path("piece_bpe_32k.model"))
    every = range(model.get_piece_size())
    normal = [i for i in every if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    of_byte = {model.id_to_piece(i): i for i in every if model.is_byte(i)}
    pieces: list[tuple[str, float] | None] = [None] * len(every)
    order = sorted(normal, key=lambda i: (-model.get_score(i), i))
    harmonic = math.log(sum(1 / (r + 1) for r in range(len(order))))
    for rank, i in enumerate(order):
        pieces[i] = (model.id_to_piece(i), model.get_score(i) if scores == "model" else -math.log(rank + 1) - harmonic)
    return Vocabulary(pieces, [of_byte[f"<0x{b:02X}>"] for b in range(256)])


class Automaton:
    """Aho-Corasick over the pieces as arrays, so that many units take a step together. State 0 is
    the root; a character is known by its class, 0 for all that no piece holds."""

    def __init__(self, vocabulary: Vocabulary):
        listed = [(i, *p) for i, p in enumerate(vocabulary.pieces) if p]
        self.fallback, size = vocabulary.fallback, len(vocabulary.pieces)
        self.length, self.score = np.zeros(size, np.int64), np.zeros(size)
        self.class_of, self.one = np.zeros(0x110000, np.uint16), np.zeros(1 << 16, bool)
        chars = sorted(set().union(*(p for _, p, _ in listed)))
        self.class_of[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        edge, depth, own = {}, [0], [-1]  # edge: (state, class) as one number to the next state
        for i, piece, score in listed:
            self.length[i], self.score[i], state = len(piece), score, 0
            for c in self.class_of[[ord(c) for c in piece]].tolist():
                key = state << 16 | c
                if key not in edge:
                    edge[key] = len(own)
                    depth.append(depth[state] + 1)
                    own.append(-1)
                state = edge[key]
            own[state] = i
            if len(piece) == 1:
                self.one[c] = True
        self.class_of[ord(" ")], self.class_of[ord(SPACE)] = self.class_of[ord(SPACE)], 0  # texts are read as they are
        self.hash(np.array([*edge], np.int64), np.array([*edge.values()], np.int32))
        self.fail, self.found = np.zeros(len(own), np.int32), np.array(own, np.int32)
        parent, last = np.divmod(np.array([0, *edge], np.int64), 1 << 16)  # states are numbered as their edges come
        self.shorter, own = np.full(size, -1, np.int32), self.found.copy()
        for d in range(1, max(depth) + 1):
            states = np.flatnonzero(np.array(depth) == d)
            if d > 1:
                self.fail[states] = self.step(self.fail[parent[states]], last[states])
            behind = self.found[self.fail[states]]  # the longest piece that ends there too
            self.shorter[own[states[own[states] >= 0]]] = behind[own[states] >= 0]
            self.found[states] = np.where(own[states] >= 0, own[states], behind)

    def hash(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = (4 * len(keys)).bit_length()
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        slot = self.slot(keys)
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]
            placed = self.keys[slot] == keys
            self.values[slot[placed]] = values[placed]
            keys, values, slot = keys[~placed], values[~placed], slot[~placed] + 1 & self.last

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def edge(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The next state in the trie, -1 where there is none."""
        key = state.astype(np.int64) << 16 | c
        slot = self.slot(key)
        held = self.keys[slot]
        out, wrong = self.values[slot], np.flatnonzero((held != key) & (held >= 0))
        while len(wrong):
            slot[wrong] = slot[wrong] + 1 & self.last
            held = self.keys[slot[wrong]]
            out[wrong] = self.values[slot[wrong]]
            wrong = wrong[(held != key[wrong]) & (held >= 0)]
        out[self.keys[slot] != key] = -1
        return out

    def step(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The next state; where the trie has none, that of the longest shorter suffix that has one."""
        out = self.edge(state, c)
        left = np.flatnonzero((out < 0) & (state > 0))
        behind = state[left]
        while len(left):
            behind = self.fail[behind]
            out[left] = found = self.edge(behind, c[left])
            more = (found < 0) & (behind > 0)
            left, behind = left[more], behind[more]
        return np.maximum(out, 0)

    def segment(self, chars: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best segmentations of units, the longest first, that start in `chars` where told: pieces of
        all (-1 - x: character x without a piece), how many each has, and scores."""
        n, most, every = len(sizes), int(sizes[0]), np.arange(len(sizes))
        best, back = np.zeros((most + 1, n)), np.zeros((most + 1, n), np.int32)
        classes, flat, state = self.class_of[chars], best.reshape(-1), np.zeros(n, np.int32)
        for at in range(most):
            k = np.searchsorted(-sizes, -at)  # those longer than that
            c = classes[starts[:k] + at]
            state = self.step(state[:k], c)
            top = np.where(self.one[c], -np.inf, best[at, :k] + self.fallback)
            link = -1 - chars[starts[:k] + at]
            piece, unit = self.found[state], every[:k]
            while True:
                more = piece >= 0
                piece, unit = piece[more], unit[more]
                if not len(unit):
                    break
                score = flat[(at + 1 - self.length[piece]) * n + unit] + self.score[piece]
                better = score > top[unit]
                top[unit[better]], link[unit[better]] = score[better], piece[better]
                piece = self.shorter[piece]
            best[at + 1, :k], back[at + 1, :k] = top, link
        counts, place, unit, taken = np.zeros(n, np.int64), sizes.copy(), every, []
        while len(unit):
            piece = back[place[unit], unit]
            taken.append((unit, piece))
            counts[unit] += 1
            place[unit] -= np.where(piece < 0, 1, self.length[np.maximum(piece, 0)])
            unit = unit[place[unit] > 0]
        ends, pieces = np.cumsum(counts), np.empty(counts.sum(), np.int32)
        for k, (unit, piece) in enumerate(taken, 1):
            pieces[ends[unit] - k] = piece
        return pieces, counts, best[sizes, every]


def runs(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Runs of `flat` one after the other."""
    before = np.cumsum(sizes) - sizes
    return flat[np.repeat(starts - before, sizes) + np.arange(sizes.sum())]


class Slots(dict):
    """Numbers of units. The first MEMO_UNITS short ones are kept (frequent words come early), so
    that a worker's memory stays bounded; others pass with numbers from MEMO_UNITS on."""

    def __init__(self):
        super().__init__()
        self.passing = {}

    def __missing__(self, unit: str) -> int:
        if len(self) < MEMO_UNITS and len(unit) < UNIT_CHARS:
            slot = self[unit] = len(self)
            return slot
        return self.passing.setdefault(unit, MEMO_UNITS + len(self.passing))


class Encoder:
    """A unit is named by its text without the word-start mark before it."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.automaton = vocabulary, Automaton(vocabulary)
        self.bytes_ = np.array(vocabulary.bytes_, np.int32)
        self.splits = not any(SPACE in p[0].lstrip(SPACE) for p in vocabulary.pieces if p)  # else a text is one unit
        self.slots, self.ids, self.sizes, self.scores = Slots(), np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0)

    @cached_property
    def search(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for i, piece in enumerate(self.vocabulary.pieces):
            if piece:
                found.add_word(piece[0], (len(piece[0]), piece[1], i))
        found.make_automaton()
        return found

    @cached_property
    def singles(self) -> set[str]:
        return {p[0] for p in self.vocabulary.pieces if p and len(p[0]) == 1}

    def segment(self, unit: str) -> tuple[np.ndarray, float]:
        """Ids and score of the best segmentation of one unit, for those too long to go together."""
        unit = SPACE + unit.replace(SPACE, LITERAL).replace(" ", SPACE)
        size, fallback = len(unit), self.automaton.fallback
        best, back = [0.0] + [-math.inf] * size, [None] * (size + 1)
        at, known = 0, self.singles.issuperset(unit)

        def bridge(upto: int) -> None:  # characters without a piece, once all before them is settled
            nonlocal at
            while at < upto:
                if unit[at] not in self.singles and best[at] + fallback > best[at + 1]:
                    best[at + 1], back[at + 1] = best[at] + fallback, (at, -1)
                at += 1

        for end, (length, score, piece) in self.search.iter(unit):
            if not known and at <= end:
                bridge(end + 1)
            start = end + 1 - length
            score += best[start]
            if score > best[end + 1]:
                best[end + 1], back[end + 1] = score, (start, piece)
        if not known:
            bridge(size)
        ids, end = [], size
        while end:
            start, piece = back[end]
            ids += [piece] if piece >= 0 else [self.vocabulary.bytes_[b] for b in reversed(unit[start].replace(LITERAL, SPACE).encode())]
            end = start
        return np.array(ids[::-1], np.int32), best[size]

    def together(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, how many each has, and scores of the best segmentations of units, the longest first."""
        chars = np.frombuffer((" " + " ".join(units)).encode("utf-32-le"), np.int32)
        lengths = np.fromiter(map(len, units), np.int64, len(units)) + 1
        pieces, counts, scores = self.automaton.segment(chars, np.cumsum(lengths) - lengths, lengths)
        without = pieces < 0
        if without.any():
            spelled = [chr(x).replace(" ", SPACE).encode() for x in (-1 - pieces[without]).tolist()]
            wide = np.ones(len(pieces), np.int64)
            wide[without] = [len(x) for x in spelled]
            counts = np.diff(np.append(0, np.cumsum(wide))[np.append(0, np.cumsum(counts))])
            pieces, without = np.repeat(pieces, wide), np.repeat(without, wide)
            pieces[without] = self.bytes_[np.frombuffer(b"".join(spelled), np.uint8)]
        return pieces, counts, scores

    def segments(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, how many each has, and scores of the best segmentations of units in any order."""
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        order = np.argsort(-lengths, kind="stable")
        long = np.count_nonzero(lengths >= UNIT_CHARS)
        alone = [self.segment(units[k]) for k in order[:long].tolist()]
        parts = [(ids, [len(ids)], [score]) for ids, score in alone]
        parts += [self.together([units[k] for k in order[a:a + TOGETHER].tolist()]) for a in range(long, len(order), TOGETHER)]
        ids, counts, scores = map(np.concatenate, zip((np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0)), *parts))
        back = np.argsort(order)
        return runs(ids, (np.cumsum(counts) - counts)[back], counts[back]), counts[back], scores[back]

    def units(self, text: str) -> list[str]:
        if not text:
            return []
        if not self.splits:
            return [text]
        return UNIT.findall(" " + text) if "  " in text or " " in (text[0], text[-1]) else text.split(" ")

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[float]]:
        """Ids of all texts, how many each has, and scores."""
        units = [self.units(x) for x in texts]
        ends = np.cumsum([0, *map(len, units)])
        kept = len(self.slots)
        slots = np.fromiter(map(self.slots.__getitem__, chain.from_iterable(units)), np.int64, ends[-1])
        passing, self.slots.passing = self.slots.passing, {}
        new = self.segments([*islice(self.slots, kept, None), *passing])
        ids, sizes, scores = map(np.concatenate, zip((self.ids, self.sizes, self.scores), new))
        starts, kept = np.cumsum(sizes) - sizes, len(self.slots)
        if kept > len(self.sizes):
            self.ids, self.sizes, self.scores = ids[:sizes[:kept].sum()], sizes[:kept], scores[:kept]
        slots[slots >= MEMO_UNITS] -= MEMO_UNITS - kept
        counts = np.diff(np.append(0, np.cumsum(sizes[slots]))[ends])
        found = [runs(ids, starts[x], sizes[x]) for x in (slots[a:a + GROUP_CHARS] for a in range(0, len(slots), GROUP_CHARS))]
        every, ends = memoryview(scores[slots]), ends.tolist()
        return np.concatenate([np.empty(0, np.int32), *found]), counts, [math.fsum(every[a:b]) for a, b in zip(ends, ends[1:])]

    def encode(self, text: str) -> tuple[np.ndarray, float]:
        ids, _, scores = self.encode_texts([text])
        return ids, scores[0]


def groups(texts: list[str]) -> Iterator[list[str]]:
    """Consecutive texts of about GROUP_CHARS characters together; a longer text is one group."""
    number = np.cumsum([0, *map(len, texts)])[:-1] // GROUP_CHARS
    for part in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(number)) + 1):
        yield texts[part[0]:part[-1] + 1]


def encode(docs: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """`docs` with ids, n_pieces and piece_score (the log score of the best segmentation)."""
    shared = docs.sparkSession.sparkContext.broadcast(Encoder(vocabulary or load_vocabulary()))  # one vocabulary file

    def work(batch: pa.RecordBatch, encoder: Encoder) -> list:
        found = [encoder.encode_texts(x) for x in groups([x or "" for x in batch["text"].to_pylist()])]
        ids, sizes = (np.concatenate([x[k] for x in found]) for k in (0, 1))
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(ids))
        return [lists, sizes, [y for x in found for y in x[2]]]

    return with_columns(docs, "ids array<int>, n_pieces long, piece_score double", work, lambda: shared.value)


def decode(encoded: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """`encoded` with decoded, the text of its ids; null ids decode to the empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary or load_vocabulary())

    def setup() -> list[bytes]:
        spelled = [p[0].replace(SPACE, " ").encode() if p else b"" for p in shared.value.pieces]
        for byte, i in enumerate(shared.value.bytes_):
            spelled[i] = bytes([byte])
        return spelled

    def work(batch: pa.RecordBatch, spelled: list[bytes]) -> list:
        every = batch["ids"].values.to_numpy(zero_copy_only=False)  # one text at a time becomes Python numbers
        offsets, null = batch["ids"].offsets.to_numpy(), batch["ids"].is_null().to_numpy(zero_copy_only=False)
        ends = np.where(null, offsets[:-1], offsets[1:]).tolist()
        return [[b"".join(map(spelled.__getitem__, every[a:b].tolist())).decode()[1:] for a, b in zip(offsets[:-1].tolist(), ends)]]

    return with_columns(encoded, "decoded string", work, setup)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = decode(encode(docs))
    return back.select("doc_id", "ids", "n_pieces", "piece_score", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))
