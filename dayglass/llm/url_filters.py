"""URL filters: allow and block rules by host suffix and path prefix, the longest rule wins.

A rule list up to `TRIE_BYTES` becomes a trie over reversed host labels and path segments that
is broadcast; a longer list is joined by the (host suffix, path prefix) pairs of each URL, path
prefixes being cut after each `/`, so that only what a rule has after its last `/` is compared apart.

Defined results: a null URL or one without `://` has an empty host and path, matches no rule and
gets the default verdict. Two rules for the same host and path: block wins. Repeated rows are
judged alike; an empty table gives an empty result. Columns named like the results are replaced.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import table, with_columns

TRIE_BYTES = 16 << 20
# fixed rules of the query: (verdict, host, path)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first `://` with A-Z lower-cased, and the path up to `?` or `#`."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    authority = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(authority, UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def build_trie(rules: list[tuple[str, str, str]]) -> dict:
    """Nested dicts: host labels from the right, then `/`, then complete path segments. Under
    `=` lie the rules that end there, as {rest of the last segment: (rule, verdict)}."""
    root: dict = {}
    for verdict, host, path in rules:
        node = root
        for label in reversed(host.split(".")):
            node = node.setdefault(label, {})
        *segments, rest = path.split("/")
        node = node.setdefault("/", {})
        for segment in segments:
            node = node.setdefault(segment + "/", {})
        ends = node.setdefault("=", {})
        if ends.get(rest, ("", "allow"))[1] == "allow":
            ends[rest] = (host + path, verdict)
    return root


def longest_match(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    """The rule with most host labels, among those the one with the longest path."""
    found, node = None, trie
    pieces = path.split("/")
    for label in reversed(host.split(".")):
        node = node.get(label)
        if node is None:
            break
        inner, k = node.get("/"), 0
        while inner is not None:
            here = [r for r in inner.get("=", ()) if "/".join(pieces[k:]).startswith(r)]
            if here:
                found = inner["="][max(here, key=len)]
            if k >= len(pieces) - 1:
                break
            inner, k = inner.get(pieces[k] + "/"), k + 1
    return found


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """`pages` with host, path, rule and verdict. `rules` has verdict, host and path."""
    spark = pages.sparkSession
    rules = rules.select("verdict", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
    size = rules.agg(F.sum(F.length("host") + F.length("path") + 32)).first()[0] or 0
    host, path = host_and_path(F.col("url"))
    pages = pages.withColumn("host", F.coalesce(host, F.lit(""))).withColumn("path", F.coalesce(path, F.lit("")))
    if size > trie_bytes:
        return _judge_by_join(pages, rules, default)
    trie = spark.sparkContext.broadcast(build_trie([tuple(r) for r in rules.collect()]))

    def work(batch: pa.RecordBatch) -> list:
        hosts, paths = batch["host"].to_pylist(), batch["path"].to_pylist()
        hits = [longest_match(trie.value, h, p) for h, p in zip(hosts, paths)]
        return [[h and h[0] for h in hits], [h[1] if h else default for h in hits]]

    return with_columns(pages, "rule string, verdict string", work)


def _judge_by_join(pages: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """For lists too long to broadcast: each URL looks up the rules at its own host suffixes and path
    prefixes up to a `/`; the unfinished segment at the end of a rule's path is compared after that."""
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # 'block' > 'allow'
    folder = F.regexp_extract("path", r"^(.*/)?", 0)
    rules = rules.select(F.col("host").alias("_h"), F.col("path").alias("_p"), folder.alias("_f"), "verdict")
    keyed = pages.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    pieces = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(0), F.size(pieces) - 1), lambda i: F.array_join(F.concat(F.slice(pieces, F.lit(1), i), F.array(F.lit(""))), "/"))
    hits = (keyed.withColumn("_s", F.explode(suffixes)).withColumn("_d", F.explode(folders))
            .join(rules, (F.col("_s") == F.col("_h")) & (F.col("_d") == F.col("_f")) & F.col("path").startswith(F.col("_p")))
            .groupBy("host", "path")
            .agg(F.max(F.struct(F.size(F.split("_h", r"\.")).alias("n"), F.length("_p").alias("m"),
                                F.concat("_h", "_p").alias("rule"), "verdict")).alias("_best")))
    pages = pages.drop("rule", "verdict").join(hits, ["host", "path"], "left")
    return pages.withColumns({"rule": F.col("_best.rule"), "verdict": F.coalesce("_best.verdict", F.lit(default))}).drop("_best")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(map(str, RULES)) + " AS t(verdict, host, path)")
    return judge(pages, rules).drop("url")


ORACLE = """
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r(verdict, rhost, rpath) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), hit AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost) * 1000 + length(rpath)) AS rule,
         arg_max(verdict, length(rhost) * 1000 + length(rpath)) AS verdict
  FROM h JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id
)
SELECT h.page_id, h.host, h.path, hit.rule AS rule, coalesce(hit.verdict, 'allow') AS verdict FROM h LEFT JOIN hit USING (page_id)
"""
