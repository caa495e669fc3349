"""Operator 1: URL rules by host suffixes and path prefixes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandcut.llm.common import ascii_lower
from strandcut.llm.registry import query, table

#: Rule lists of up to so many rows are sent to all tasks; longer ones are joined by shuffle.
BROADCAST_RULES = 100_000
PREFIX_HEX = 8

Rule = tuple[str, str, str]

# The rules of the query.
RULES: list[Rule] = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://`` or for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return (
        ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)),
        F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1),
    )


def _folder(path: Column) -> Column:
    """The path up to its last slash; empty without one."""
    return F.regexp_extract(path, r"(?s)^(.*/)?", 0)


def _digest(host: Column, folder: Column) -> Column:
    return F.sha2(F.concat_ws("\n", host, folder), 256)


def indexed_rules(rules: DataFrame) -> DataFrame:
    """Rules ``action, host, path`` with the digest of host and folder, its prefix and their depths."""
    host = ascii_lower(F.coalesce("host", F.lit("")))
    path = F.coalesce("path", F.lit(""))
    base = rules.select(
        F.col("action").alias("verdict"), host.alias("rule_host"), path.alias("rule_path"),
        F.concat(host, path).alias("rule"), _folder(path).alias("folder"),
    )
    digest = _digest(F.col("rule_host"), F.col("folder"))
    return base.select(
        "verdict", "rule_path", "rule",
        digest.alias("rule_digest"), F.substring(digest, 1, PREFIX_HEX).alias("prefix"),
        F.size(F.split("rule_host", r"\.")).alias("labels"),
        F.length(F.regexp_replace("folder", "[^/]", "")).alias("slashes"),
    )


def judge_urls(pages: DataFrame, rules: DataFrame, *, url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host, path, rule, verdict``; columns of these names are replaced.

    Every distinct address is expanded into host suffixes times path prefixes
    that end in a slash, no deeper than the deepest rule. Their digests' short
    prefixes are equi-joined with the rules'; the full digest and the rest of
    the rule's path confirm. The longest rule wins, then the longer path, then
    ``block``. Without a rule (or without a host: null urls, no ``://``) the
    verdict is ``default``. An empty rule list judges all by default. Repeated
    pages stay.
    """
    host, path = split_url(F.col(url_col))
    taken = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    based = pages.withColumns({"__host": host, "__path": path}).select(
        *[F.col(f"`{c}`") for c in taken], F.coalesce("__host", F.lit("")).alias("host"),
        F.coalesce("__path", F.lit("")).alias("path"),
    )
    index = indexed_rules(rules)
    count, labels, slashes = index.agg(
        F.count(F.lit(1)), F.coalesce(F.max("labels"), F.lit(0)), F.coalesce(F.max("slashes"), F.lit(0))
    ).first()
    addresses = based.select("host", "path").distinct()
    words = F.split("host", r"\.")
    deepest = F.least(F.size(words), F.lit(labels))
    parts = F.split("path", "/")
    depth = F.least(F.size(parts) - 1, F.lit(slashes))
    expanded = (
        addresses.where("host <> ''")
        .withColumns({"words": words, "parts": parts})
        .withColumn("suffix", F.explode(F.transform(
            F.sequence(F.lit(1), F.greatest(deepest, F.lit(1))),
            lambda k: F.array_join(F.slice("words", F.size("words") - k + 1, k), "."))))
        .withColumn("folder", F.explode(F.transform(
            F.sequence(F.lit(0), F.greatest(depth, F.lit(0))),
            lambda k: F.concat(F.array_join(F.slice("parts", 1, k), "/"), F.when(k > 0, "/").otherwise("")))))
        .withColumn("digest", _digest(F.col("suffix"), F.col("folder")))
        .select("host", "path", "digest", F.substring("digest", 1, PREFIX_HEX).alias("prefix"))
    )
    if count <= BROADCAST_RULES:
        index = F.broadcast(index)
    hits = expanded.join(index, "prefix").where(
        (F.col("digest") == F.col("rule_digest")) & F.startswith(F.col("path"), F.col("rule_path"))
    )
    best = hits.groupBy("host", "path").agg(
        F.max(F.struct(
            F.length("rule").alias("n"), F.length("rule_path").alias("m"), F.col("verdict"), F.col("rule")
        )).alias("best")
    )
    return based.join(best, ["host", "path"], "left").select(
        *[F.col(f"`{c}`") for c in taken], "host", "path",
        F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )


def rule_table(spark: SparkSession, rules: Sequence[Rule] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "action string, host string, path string")


URL_SQL = r"""
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r
  FROM pages),
parts AS (
  SELECT page_id,
    translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest)
SELECT page_id, host, path,
  CASE WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND prefix(path, '/en/') THEN 'example.net/en/'
       WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/de/') THEN 'example.com/de/'
       WHEN (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/fr/') THEN 'org/fr/'
       WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/') THEN 'net/' END AS rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM parts
"""


@query("op1_url_filters", URL_SQL)
def url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")
