"""Quality rules with risk-controlled thresholds.

Every text gets a few statistics. For each rule and stratum (language) the cutoff is the
strictest one whose rate of falsely rejected good texts is proven small: labelled texts give the
number k of good ones beyond the cutoff among n, and the exact binomial (Clopper-Pearson) upper
bound must not exceed the rule's share of `risk`. Cutoffs are tested from the loosest on and the
first failure ends the sequence, so that only the rule-stratum chains need a Bonferroni
correction. The rules of a stratum share its risk evenly: all together reject at most `risk` of
its good texts, in all strata at once with confidence 1 - `error`. A stratum with too few labels
gets no cutoffs, and its texts are judged by the base rules alone. Copies of a text are one trial, as
the bound asks for independent ones.

Defined results: null texts have no words and fail the base rule; null strata form one of their
own; a text with several labels counts as good only if all say so; repeated rows are judged each;
an empty table gives an empty result and columns named like the results are replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import materialize
from .common import table, whole_text, with_columns

SYMBOLS = b"#*$%&|<>"
COPY = "_copy"  # digest of the text, the same for copies
RISK, ERROR, WINDOW = 0.02, 0.05, 5
# statistic of each rule (large is bad) and its cutoffs, loosest first
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", (0.5, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02, 0.01)),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", (0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1)),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", (0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.04)),
    "long_words": ("word_chars / greatest(n_words, 1)", (40.0, 30.0, 25.0, 20.0, 16.0, 14.0, 12.0, 11.0, 10.0)),
}


def text_counts(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines of one text."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    data = text.encode()
    words = data.split()  # ASCII white space is just the space and 0x09-0x0D
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    lines = [x for x in data.split(b"\n") if x.strip()]
    return (len(words), chars, len(data) - len(data.translate(None, SYMBOLS)), len(lines) - len(set(lines)),
            repeated_words(words), len(lines))


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of five that are found at least twice, the first included."""
    windows = list(zip(*(words[k:] for k in range(WINDOW))))
    if len(set(windows)) == len(windows):
        return 0
    seen: dict = {}
    number = np.fromiter((seen.setdefault(w, len(seen)) for w in windows), np.int64, len(windows))
    again = np.flatnonzero(np.bincount(number)[number] > 1)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, again, 1)
    np.add.at(change, again + WINDOW, -1)
    return int(np.count_nonzero(np.cumsum(change)))


def with_counts(docs: DataFrame) -> DataFrame:
    """`docs` without the text, with its counts."""
    fields = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"

    def work(batch: pa.RecordBatch) -> list:
        counts = [text_counts(x) for x in batch["text"].to_pylist()]
        return list(np.array(counts, np.int64).reshape(-1, 6).T)

    return with_columns(docs, fields, work).drop("text")


def base_failed() -> Column:
    return F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words")


def tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial variable."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))


def certified(k: int, n: int, risk: float, error: float) -> bool:
    """Whether the exact upper bound of the rate behind k of n is at most `risk`."""
    return n > 0 and k < n * risk and tail(k, n, risk) <= error


def fit_cutoffs(counted: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, error: float = ERROR) -> DataFrame:
    """One row for each stratum with labels: the cutoff of each rule, null where none is proven.

    One aggregate over the labelled texts counts, for all cutoffs at once, the good ones beyond.
    """
    truth = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("_good"))
    good = counted.where(~base_failed()).join(truth.where("_good = 1"), "doc_id").withColumn("_stratum", F.coalesce(stratum, F.lit("")))
    if COPY in counted.columns:
        good = good.dropDuplicates(["_stratum", COPY])
    beyond = [F.sum((F.expr(stat) > cut).cast("long")).alias(f"{rule}_{j}") for rule, (stat, cuts) in RULES.items() for j, cut in enumerate(cuts)]
    beyond_by_stratum = good.groupBy("_stratum").agg(F.count("*").alias("n"), *beyond)
    chains = len(RULES) * max(1, counted.select(F.coalesce(stratum, F.lit(""))).distinct().count())

    def choose(frames):
        for frame in frames:
            for rule, (_, cuts) in RULES.items():
                chosen = []
                for row in frame.to_dict("records"):
                    best = None
                    for j, cut in enumerate(cuts):
                        if not certified(row[f"{rule}_{j}"], row["n"], risk / len(RULES), error / chains):
                            break
                        best = cut
                    chosen.append(best)
                frame[f"cut_{rule}"] = np.array(chosen, dtype=float)
            yield frame[["_stratum", *(f"cut_{rule}" for rule in RULES)]]

    return beyond_by_stratum.mapInPandas(choose, "_stratum string, " + ", ".join(f"cut_{rule} double" for rule in RULES))


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, error: float = ERROR) -> DataFrame:
    """`docs` without text, with the counts, base_failed, the first rule that rejects, and kept."""
    counted = materialize(with_counts(docs.withColumn(COPY, F.md5(whole_text()))), "quality-counts")
    cuts = materialize(fit_cutoffs(counted, labels, stratum, risk, error), "quality-cuts")  # a row a stratum: Spark sees its size
    joined = counted.join(cuts, F.coalesce(counted[stratum], F.lit("")) == cuts["_stratum"], "left")
    rejecting = F.coalesce(F.when(base_failed(), F.lit("base")),
                           *(F.when((F.expr(stat) > F.col(f"cut_{rule}")) & ~F.isnan(f"cut_{rule}"), F.lit(rule)) for rule, (stat, _) in RULES.items()))
    return (joined.withColumn("base_failed", base_failed()).withColumn("rejected_by", rejecting)
            .withColumn("kept", F.col("rejected_by").isNull()).drop("_stratum", COPY, *(f"cut_{rule}" for rule in RULES)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    judged = judge(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by")


_CHAINS = "\n  UNION ALL ".join(
    f"SELECT _stratum, '{rule}' AS rule, {j} AS j, {cut} AS cut, count(*) AS n, count(*) FILTER (({stat}) > {cut}) AS k FROM trial GROUP BY _stratum"
    for rule, (stat, cuts) in RULES.items() for j, cut in enumerate(cuts))
ORACLE = f"""
WITH d AS (
  SELECT doc_id, lang, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents
), w AS (
  SELECT r, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d
), win AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c
  FROM (SELECT r, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS win FROM (SELECT r, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w))
), again AS (
  SELECT r, count(DISTINCT i + o) AS n FROM win, range({WINDOW}) t(o) WHERE c > 1 GROUP BY r
), counted AS (
  SELECT d.doc_id, coalesce(d.lang, '') AS _stratum, md5(d.text) AS copy, len(words) AS n_words, length(regexp_replace(d.text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
         length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(a.n, 0) AS n_repeat_words, len(lines) AS n_lines
  FROM d JOIN w USING (r) LEFT JOIN again a USING (r)
), truth AS (
  SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1
), trial AS (
  SELECT DISTINCT ON (_stratum, copy) * FROM counted JOIN truth USING (doc_id) WHERE NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
), chain AS (
  {_CHAINS}
), tested AS (
  SELECT *, k < n * {RISK / len(RULES)} AND list_sum(list_transform(range(k + 1), lambda i: exp(lgamma(n + 1) - CASE WHEN i = 0 THEN 0 ELSE lgamma(i + 1) END
           - lgamma(n - i + 1) + i * ln({RISK / len(RULES)}) + (n - i) * ln(1 - {RISK / len(RULES)})))) <= {ERROR / len(RULES)} / strata AS ok
  FROM chain, (SELECT greatest(1, count(DISTINCT _stratum)) AS strata FROM counted)
), cuts AS (
  SELECT _stratum, {", ".join(f"min(cut) FILTER (rule = '{rule}' AND j < stop) AS cut_{rule}" for rule in RULES)}
  FROM (SELECT *, coalesce(min(j) FILTER (NOT ok) OVER (PARTITION BY _stratum, rule), 1000) AS stop FROM tested) GROUP BY _stratum
), judged AS (
  SELECT c.*, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         CASE WHEN n_words < 10 OR 100 * n_repeat_words > 20 * n_words THEN 'base' {" ".join(f"WHEN {stat} > cut_{rule} THEN '{rule}'" for rule, (stat, _) in RULES.items())} END AS rejected_by
  FROM counted c LEFT JOIN cuts USING (_stratum)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, rejected_by IS NULL AS kept, rejected_by FROM judged
"""
