"""Toxicity by maximum-scoring segments.

Training: labelled texts count, for each word and each of its prefixes, the texts of either label
that hold it (hashed into `BUCKETS`, so that the model has a fixed size). The log-odds of a
feature use a Dirichlet prior that follows its frequency in all labelled texts; what counts is
the lower end of the estimate, so rare chance finds stay low. A word scores the best of its
features, or `-DRIFT` where none speaks for toxicity or the word merely repeats the one before.

Scoring: one pass over a text finds all maximal segments (those no longer or shorter segment can
better, the linear scan with a stack). The scores of chance segments follow an extreme-value law
1 - exp(-K n exp(-l S)): l solves sum p(s) exp(l s) = 1 over the token scores of clean labelled
texts, K comes from their greatest segments. A text's evidence is the surprise of its best
segment plus that of all further significant ones; a logistic curve turns it into a score.
Evidence for l, K and the curve comes from features counted in the other half of the training
texts, so it is not flattered.

Only labelled texts with crc32(doc_id) mod 3 other than 1 are learned from; labels, language,
source and id never enter a score.

Defined results: null and empty texts hold no segment and get the curve's value at the lowest
evidence; texts with contradicting labels or none are not learned from; repeated rows score
alike; without toxic or without clean labelled texts every score is 0; columns named like the
results are replaced.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import materialize
from .common import Memo, id_filter, id_remainder, map_columns, may_hold, table, whole_text, with_columns

BUCKETS = 1 << 20
PREFIXES = (3, 4, 5, 6, 7, 8)
PRIOR, CAUTION, DRIFT, LEAST, TOP = 0.02, 1.0, 0.1, 2.0, 10.0  # word scores below LEAST say nothing
RARE = math.log(20)  # surprise from which a further segment adds to a text's evidence
HELD_OUT, HELD_OUT_IS = 3, 1
REJECT = 0.7
FLOOR, CEILING, STEP = -8.0, 60.0, 0.25  # of evidence, and its bins
TOKEN = re.compile(r"\w+")


def features(word: str) -> list[int]:
    """Buckets of a lower-cased word and its prefixes."""
    keys = ["=" + word, *(word[:k] for k in PREFIXES if k <= len(word))]
    return [zlib.crc32(k.encode()) % BUCKETS for k in keys]


def maximal_segments(places: np.ndarray, gains: np.ndarray, drift: float) -> list[tuple[float, int, int]]:
    """All maximal-scoring segments (score, first token, last token) of a sequence that scores
    `gains` at `places` and `-drift` elsewhere, in one pass with a stack of candidates. Each
    candidate links to the last one before it that starts from a lower sum, so no candidate is
    looked at twice."""
    stack: list[tuple] = []  # (sum before the segment, sum after it, first, last, link)
    total, at = 0.0, 0
    for place, gain in zip(places.tolist(), gains.tolist()):
        total -= drift * (place - at)
        left, right, first = total, total + gain, place
        total, at = right, place + 1
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][1] >= right:
                stack.append((left, right, first, place, j))
                break
            left, first = stack[j][0], stack[j][2]
            del stack[j:]
    return [(right - left, first, last) for left, right, first, last, _ in stack]


@dataclass
class Model:
    """Lower log-odds by bucket, the law of chance segments and the curve of the scores."""
    odds: np.ndarray | None
    rate: float = 1.0      # l
    factor: float = 1.0    # K
    slope: float = 0.0
    intercept: float = 0.0

    def word_scorer(self) -> Memo:
        odds = self.odds

        def gain(word: str) -> float:
            value = float(max(odds[k] for k in features(word)))
            return min(value, TOP) if value >= LEAST else 0.0

        return Memo(gain)

    def evidence(self, n: int, scores: list[float]) -> float:
        chance = math.log(self.factor * max(n, 1))
        surprises = [self.rate * s - chance for s in scores]
        if not surprises:
            return max(FLOOR, min(CEILING, -max(chance, 0.0)))
        best = max(surprises)
        further = sum(x - RARE for x in surprises if x > RARE) - max(best - RARE, 0.0)
        return max(FLOOR, min(CEILING, best + further))

    def score(self, evidence: float) -> float:
        if self.odds is None:
            return 0.0
        x = self.intercept + self.slope * evidence
        return 1 / (1 + math.exp(-x)) if x > -500 else 0.0


def token_gains(text: str, scorer: Memo) -> np.ndarray:
    """Score of each word; a word that repeats the one before it adds nothing."""
    words = TOKEN.findall(text.lower())
    gains = np.fromiter(map(scorer.__getitem__, words), np.float64, len(words))
    for place in np.flatnonzero(gains).tolist():
        if place and words[place] == words[place - 1]:
            gains[place] = 0.0
    return gains


def segments_of(gains: np.ndarray) -> list[tuple[float, int, int]]:
    places = np.flatnonzero(gains)
    return maximal_segments(places, gains[places], DRIFT)


def lower_odds(toxic: Column, clean: Column, n_toxic: int, n_clean: int) -> Column:
    """Log-odds of holding the feature, toxic against clean, less `CAUTION` standard errors; null
    where no toxic text holds it."""
    a, b = toxic + PRIOR * (toxic + clean), clean + PRIOR * (toxic + clean)
    weight = PRIOR * (n_toxic + n_clean)
    odds = F.log(a) - F.log(n_toxic + weight - a) - F.log(b) + F.log(n_clean + weight - b)
    return F.when(toxic > 0, odds - CAUTION * F.sqrt(1 / a + 1 / b))


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled texts to learn from: text, toxic, half."""
    truth = (labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id")
             .agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_other")).where("toxic = _other").drop("_other"))
    # a filter of fixed size drops nearly all unlabelled texts before the join moves any
    shared = docs.sparkSession.sparkContext.broadcast(id_filter(truth.select(F.xxhash64(F.col("doc_id").cast("long")).alias("_h"))))

    def labelled(batches):
        for batch in batches:
            yield batch.filter(pa.array(may_hold(shared.value, batch["_h"].to_numpy()))).columns

    rows = docs.where(id_remainder(HELD_OUT) != HELD_OUT_IS).select("doc_id", F.xxhash64(F.col("doc_id").cast("long")).alias("_h"), whole_text().alias("text"))
    open_ids = map_columns(rows, rows.schema, labelled).drop("_h")
    half = F.crc32(F.concat(F.lit("half"), F.col("doc_id").cast("string"))) % 2
    # labels grow with the corpus: the same plan at every size, over labelled texts alone
    return open_ids.join(truth.hint("merge"), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"), half.cast("int").alias("half"))


def count_features(rows: DataFrame) -> DataFrame:
    """Texts that hold each bucket, by half and label; bucket -1 counts the texts themselves."""
    def work(batches):
        counts = np.zeros((4, BUCKETS), np.int32)
        texts = np.zeros(4, np.int64)
        buckets = Memo(features, 100_000)
        for batch in batches:
            for text, toxic, half in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), batch["half"].to_pylist()):
                words = set(TOKEN.findall(text.lower()))
                held = np.unique(np.fromiter((k for w in words for k in buckets[w]), np.int64))
                counts[2 * half + toxic, held] += 1
                texts[2 * half + toxic] += 1
        for cell in range(4):
            held = np.flatnonzero(counts[cell])
            yield [np.full(len(held) + 1, cell, np.int32), np.append(held, -1).astype(np.int32), np.append(counts[cell][held], texts[cell])]

    return map_columns(rows, "cell int, bucket int, n long", work).groupBy("bucket").agg(
        *(F.sum(F.when(F.col("cell") == c, F.col("n")).otherwise(0)).alias(f"n{c}") for c in range(4)))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    spark = docs.sparkSession
    rows = materialize(training_rows(docs, labels), "toxic-training")
    counts = materialize(count_features(rows), "toxic-counts")
    texts = list(counts.where("bucket = -1").select("n0", "n1", "n2", "n3").first() or (0, 0, 0, 0))
    if min(texts[0] + texts[2], texts[1] + texts[3]) == 0:
        return Model(None)
    clean, toxic = [F.col("n0"), F.col("n2")], [F.col("n1"), F.col("n3")]
    # in `half0` the features of half 1 alone, and the other way round
    odds = {"whole": lower_odds(toxic[0] + toxic[1], clean[0] + clean[1], texts[1] + texts[3], texts[0] + texts[2]),
            "half0": lower_odds(toxic[1], clean[1], texts[3], texts[2]), "half1": lower_odds(toxic[0], clean[0], texts[1], texts[0])}
    telling = counts.where("bucket >= 0").select("bucket", *(c.cast("float").alias(k) for k, c in odds.items()))
    telling = telling.where(" OR ".join(f"{k} >= {LEAST}" for k in odds)).toPandas()  # at most BUCKETS rows, mostly a few
    dense = np.full((3, BUCKETS), -1.0, np.float32)
    dense[:, telling["bucket"].to_numpy()] = telling[["whole", "half0", "half1"]].fillna(-1.0).to_numpy(np.float32).T
    model = Model(dense[0])
    shared = spark.sparkContext.broadcast([dense[1], dense[2]])
    usable = [texts[3] > 0 and texts[2] > 0, texts[1] > 0 and texts[0] > 0]  # a half without toxic texts has no say
    seen = materialize(_scored_training(rows, shared, usable), "toxic-evidence")
    _fit_law(model, seen)
    _fit_curve(model, seen)
    return model


BINS = int(TOP / 0.1) + 1


def _scored_training(rows: DataFrame, shared, usable: list) -> DataFrame:
    """Segments of each training text (kind 0) and token scores of clean ones in bins (kind 1)."""
    def work(batches):
        scorers = [Model(odds).word_scorer() for odds in shared.value]
        bins = np.zeros(BINS, np.int64)
        for batch in batches:
            out = [[], [], [], [], []]
            for text, toxic, half in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), batch["half"].to_pylist()):
                if not usable[half]:
                    continue
                gains = token_gains(text, scorers[half])
                n, segments = len(gains), segments_of(gains)
                if not toxic:
                    bins += np.bincount(np.round(gains * 10).astype(int), minlength=BINS)
                for column, value in zip(out, (0, toxic, n, [s for s, _, _ in segments], 1)):
                    column.append(value)
            yield out
        held = np.flatnonzero(bins)
        yield [np.ones(len(held), np.int32), np.zeros(len(held), np.int32), held, [[]] * len(held), bins[held]]

    return map_columns(rows, "kind int, toxic int, n long, segments array<double>, times long", work)


def _fit_law(model: Model, seen: DataFrame) -> None:
    bins = seen.where("kind = 1").groupBy("n").agg(F.sum("times").alias("times")).toPandas()  # at most BINS rows
    values = bins["n"].to_numpy(np.float64) / 10
    values = np.where(values > 0, values, -DRIFT)
    share = bins["times"].to_numpy(np.float64) / max(bins["times"].sum(), 1)
    if (values > 0).any() and (share * values).sum() < 0:
        low, high = 0.0, 1.0
        while (share * np.exp(high * values)).sum() < 1 and high < 64:
            high *= 2
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if (share * np.exp(mid * values)).sum() < 1 else (low, mid)
        model.rate = max(high, 0.05)
    best = F.coalesce(F.array_max("segments"), F.lit(0.0))
    clean = seen.where("kind = 0 AND toxic = 0").agg(F.count("*"), F.sum(F.greatest("n", F.lit(1)) * F.exp(-model.rate * best))).first()
    model.factor = clean[0] / clean[1] if clean[0] else 1.0


def _evidence(model: Model) -> Column:
    """`Model.evidence` over the columns n and segments."""
    chance = F.log(F.lit(model.factor) * F.greatest("n", F.lit(1)))
    surprises = F.transform("segments", lambda s: F.lit(model.rate) * s - chance)
    best = F.array_max(surprises)
    beyond = F.aggregate(surprises, F.lit(0.0), lambda a, x: a + F.greatest(x - RARE, F.lit(0.0)))
    value = F.coalesce(best + beyond - F.greatest(best - RARE, F.lit(0.0)), -F.greatest(chance, F.lit(0.0)))
    return F.least(F.greatest(value, F.lit(FLOOR)), F.lit(CEILING))


def _fit_curve(model: Model, seen: DataFrame) -> None:
    """Logistic regression on evidence in bins, with a weak pull to zero."""
    x = F.round(_evidence(model) / STEP).cast("int")
    bins = (seen.where("kind = 0").groupBy(x.alias("x"))
            .agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n")).toPandas())  # (CEILING - FLOOR) / STEP rows at most
    x, toxic, n = bins["x"].to_numpy(np.float64) * STEP, bins["toxic"].to_numpy(np.float64), bins["n"].to_numpy(np.float64)
    if not len(x):
        model.slope, model.intercept = 1.0, -3.0
        return
    design, beta = np.stack([np.ones_like(x), x], axis=1), np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (toxic - n * p) - 0.1 * beta
        hessian = (design * (n * p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    model.intercept, model.slope = float(beta[0]), float(max(beta[1], 0.0))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with score, predicted and passages: (first token, last token, surprise) of each
    significant segment."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch, scorer: Memo) -> list:
        model = shared.value
        if model.odds is None:
            return [[0.0] * len(batch), [0] * len(batch), [[]] * len(batch)]
        scores, passages = [], []
        for text in batch["text"].to_pylist():
            gains = token_gains(text or "", scorer)
            n, segments = len(gains), segments_of(gains)
            chance = math.log(model.factor * max(n, 1))
            scores.append(model.score(model.evidence(n, [s for s, _, _ in segments])))
            passages.append([{"first": a, "last": b, "surprise": model.rate * s - chance} for s, a, b in segments if model.rate * s > chance])
        return [scores, [int(s >= REJECT) for s in scores], passages]

    return with_columns(docs, "score double, predicted int, passages array<struct<first:int,last:int,surprise:double>>", work,
                        lambda: shared.value.word_scorer())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    held_out = id_remainder(HELD_OUT) == HELD_OUT_IS
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted", F.size("passages").cast("long").alias("n_passages"))
