"""The corpus pipeline: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from dayglass.llm import jaccard_join, mixing, pieces, secret_scans, toxicity
from dayglass.llm.common import table
from dayglass.session import shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
# target weights of the mixture: src0, a third of the documents, gets 6 of 25 blocks where all twenty sources are there
WEIGHTS, OTHER_SOURCES = {"src0": 6.0}, 1.0


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; it is fitted on the labelled ones among `docs`."""
    docs = docs.select(COLUMNS)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.score(docs, model).where("predicted = 0").select(COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return jaccard_join.deduplicate(docs.select(COLUMNS))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Found secrets are replaced in the texts; `n_chars` follows. All documents stay."""
    docs = docs.select(COLUMNS)
    ledger = secret_scans.update_ledger(docs, secret_scans.ledger_path(spark))
    clean = secret_scans.redact(docs, ledger)
    return clean.withColumn("n_chars", F.when(F.col("text").contains(secret_scans.MARK), F.char_length("text").cast("long")).otherwise(F.col("n_chars")))


def placed(docs: DataFrame) -> DataFrame:
    """All documents with their slot and place in the mixture; it depends on ids, sources and texts alone."""
    return mixing.mix(docs.select(COLUMNS), WEIGHTS, other=OTHER_SOURCES)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, stored in the order of the mixture: files and rows by slot."""
    return placed(docs).repartitionByRange("slot", "place").sortWithinPartitions("slot", "place").select(COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, and its slot and place in the mixture, as files keep no order."""
    return pieces.encode(placed(docs)).select("doc_id", "lang", "source", "n_chars", "ids", "n_pieces", "piece_score", "slot", "place")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", one_of_each_group),
    ("secret_scans", without_secrets),
    ("mixing", mixed),
    ("sentencepiece", encoded),
]
# a fitted model, MinHash and Viterbi have no SQL; the tests hold run() against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over `documents`."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
