"""Secret scans with an incremental blob ledger.

Texts are addressed by their SHA-256. The ledger has one row for each (blob, rule, version) that
was ever scanned, found spans or none. A scan reads only blobs with unseen pairs, each once
whatever the number of its copies, appends to the ledger, and joins findings back to all paths.

Defined results: null texts count as empty; texts without findings have zero counts, an empty
`spans` and the digest of the empty string. Copies share a blob, ties of start are ordered as the
rules are listed, extra columns of the input stay out of the way, an empty table gives none.
"""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import shared_folder
from .common import map_columns, table, whole_text, with_columns

LEDGER = "blob string, rule string, version int, starts array<int>, ends array<int>"
# (name, version, pattern, group whose length counts, least length); assign, access and hex are fixed by the contract
RULES = (
    ("assign", 1, r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    ("access", 1, r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", 1, r"[0-9a-f]+", 0, 32),
    ("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]*-----END [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("hubtoken", 1, r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
)
BASE = ("assign", "access", "hex")
MARK = "<secret>"


def find(text: str, rule: tuple) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, without those that are too short (they still consume)."""
    _, _, pattern, group, least = rule
    return [m.span() for m in re.finditer(pattern, text) if len(m[group]) >= least]


def quick_find(text: str, lower: str, rule: tuple) -> list[tuple[int, int]]:
    """As `find`, skipping texts that cannot match and letters that start no long run."""
    name = rule[0]
    if name == "assign" and not ("passw" in lower or "secret" in lower or "token" in lower or "api" in lower):
        return []
    if name == "access" and "AKIA" not in text or name == "pem" and "-----BEGIN" not in text:
        return []
    if name == "hex":  # a run is maximal, so asking for its length in the pattern finds the same ones
        return [m.span() for m in HEX_RUN.finditer(text)]
    return find(text, rule)


HEX_RUN = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")


def unseen_blobs(docs: DataFrame, ledger: DataFrame | None, rules=RULES) -> DataFrame:
    """One row for each blob with pairs that the ledger lacks: blob, text, todo (rule indexes)."""
    blobs = docs.select(F.sha2(whole_text(), 256).alias("blob"), whole_text().alias("text"))
    wanted = F.array(*(F.lit(f"{r[0]}/{r[1]}") for r in rules))
    if ledger is not None:
        ledger = ledger.where(F.concat_ws("/", "rule", "version").isin([f"{r[0]}/{r[1]}" for r in rules]))
        seen = ledger.groupBy("blob").agg(F.collect_set(F.concat_ws("/", "rule", "version")).alias("_seen"))
        blobs = blobs.join(seen, "blob", "left").withColumn("todo", F.array_except(wanted, F.coalesce("_seen", F.array().cast("array<string>"))))
        blobs = blobs.where(F.size("todo") > 0)
    else:
        blobs = blobs.withColumn("todo", wanted)
    return blobs.groupBy("blob").agg(F.first("text").alias("text"), F.first("todo").alias("todo"))


def scan_blobs(blobs: DataFrame, rules=RULES) -> DataFrame:
    """Ledger rows of the pairs that `todo` names."""
    by_key = {f"{r[0]}/{r[1]}": r for r in rules}

    def work(batches):
        for batch in batches:
            out = [[], [], [], [], []]
            for blob, text, todo in zip(batch["blob"].to_pylist(), batch["text"].to_pylist(), batch["todo"].to_pylist()):
                lower = text.lower()
                for key in todo:
                    spans = quick_find(text, lower, by_key[key])
                    row = (blob, by_key[key][0], by_key[key][1], [a for a, _ in spans], [b for _, b in spans])
                    for column, value in zip(out, row):
                        column.append(value)
            yield out

    return map_columns(blobs, LEDGER, work)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{LEDGER}, scan string").parquet(path)


def update_ledger(docs: DataFrame, path: str, rules=RULES, scan: str | None = None) -> DataFrame:
    """Scan what the ledger at `path` lacks, add it as scan `scan`, and return the whole ledger.

    A scan that is repeated under its name replaces what it wrote before. Scans that overlap in
    time may both hold a pair; `findings` counts it once.
    """
    spark, scan = docs.sparkSession, scan or uuid.uuid4().hex
    try:
        ledger = read_ledger(spark, path).where(F.col("scan") != scan)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        ledger = None  # the first scan
    scan_blobs(unseen_blobs(docs, ledger, rules), rules).write.mode("overwrite").parquet(f"{path}/scan={scan}")
    return read_ledger(spark, path).drop("scan")


def findings(ledger: DataFrame, rules=RULES) -> DataFrame:
    """One row for each blob with findings: blob, found = array of (start, place, kind, end). A
    (blob, rule, version) that the ledger holds more than once counts once."""
    order = F.create_map(*(F.lit(x) for k, r in enumerate(rules) for x in (r[0], k)))
    current = F.concat_ws("/", "rule", "version").isin([f"{r[0]}/{r[1]}" for r in rules])
    spans = F.transform(F.arrays_zip("starts", "ends"), lambda s: F.struct(
        s["starts"].alias("start"), order[F.col("rule")].alias("place"), F.col("rule").alias("kind"), s["ends"].alias("end")))
    return (ledger.where(current & (F.size("starts") > 0)).select("blob", spans.alias("found"))
            .groupBy("blob").agg(F.sort_array(F.flatten(F.collect_set("found"))).alias("found")))


def with_findings(docs: DataFrame, ledger: DataFrame, rules=RULES) -> DataFrame:
    """`docs` with the column `found` (null where the text has no findings), at every path."""
    keyed = docs.drop("found").withColumn("_blob", F.sha2(whole_text(), 256))
    found = findings(ledger, rules).withColumnRenamed("blob", "_blob")
    return keyed.join(found, "_blob", "left").drop("_blob")


def redact(docs: DataFrame, ledger: DataFrame, rules=RULES, mark: str = MARK) -> DataFrame:
    """`docs` with each found span (overlapping ones as one) replaced by `mark`."""
    def work(batch: pa.RecordBatch) -> list:
        texts = []
        for text, found in zip(batch["text"].to_pylist(), batch["found"].to_pylist()):
            if found:
                parts, at = [], 0
                for span in found:
                    if span["start"] >= at:
                        parts += [text[at:span["start"]], mark]
                    at = max(at, span["end"])
                text = "".join([*parts, text[at:]])
            texts.append(text)
        return [texts]

    marked = with_findings(docs, ledger, rules)
    return with_columns(marked, "text string", work).drop("found").select(docs.columns)


def ledger_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = update_ledger(docs, ledger_path(spark))
    marked = with_findings(docs, ledger).drop("text")
    every = F.coalesce("found", F.array().cast("array<struct<start:int,place:int,kind:string,end:int>>"))
    of_base = F.filter(every, lambda s: s["place"] < len(BASE))
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter(every, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in BASE]
    return marked.select("doc_id", *counts, F.sha2(written(of_base), 256).alias("base_sha256"), written(every).alias("spans"))
