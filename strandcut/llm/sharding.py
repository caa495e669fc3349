"""Operator 7: a reproducible shuffle into shards by a Feistel permutation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandcut.llm.common import carried, range_chunk
from strandcut.llm.registry import query, table

ROUNDS = 6
#: Walks out of the rest of the domain; one more is needed once in sqrt(rows) at most.
WALKS = 64
CHUNK_ROWS = 1_000


def sides(rows: int) -> tuple[int, int]:
    """The two halves of the domain: their product holds ``rows`` with little to spare."""
    a = max(1, math.isqrt(max(0, rows - 1)) + 1)
    return a, max(1, -(-rows // a))


def _mix(value: Column, key: Column) -> Column:
    text = F.concat_ws(":", value.cast("string"), key)
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def _once(x: Column, rows: int, seed: int) -> Column:
    """One pass of the network: (left, right) to (right, left + mix(right)), sides swapping."""
    a, b = sides(rows)
    keys = F.array(*[
        F.struct(F.lit(f"{seed}-{i}").alias("key"), F.lit(a if i % 2 == 0 else b).cast("bigint").alias("size"))
        for i in range(ROUNDS)
    ])
    start = F.struct(F.floor(x / b).cast("bigint").alias("l"), F.pmod(x, F.lit(b)).cast("bigint").alias("r"))
    end = F.aggregate(
        keys, start,
        lambda s, k: F.struct(s["r"].alias("l"), F.pmod(s["l"] + _mix(s["r"], k["key"]), k["size"]).alias("r")),
        lambda s: s["l"] * F.lit(b).cast("bigint") + s["r"],
    )
    return end


def _once_back(x: Column, rows: int, seed: int) -> Column:
    a, b = sides(rows)
    keys = F.array(*[
        F.struct(F.lit(f"{seed}-{i}").alias("key"), F.lit(a if i % 2 == 0 else b).cast("bigint").alias("size"))
        for i in reversed(range(ROUNDS))
    ])
    start = F.struct(F.floor(x / b).cast("bigint").alias("l"), F.pmod(x, F.lit(b)).cast("bigint").alias("r"))
    return F.aggregate(
        keys, start,
        lambda s, k: F.struct(F.pmod(s["r"] - _mix(s["l"], k["key"]), k["size"]).alias("l"), s["l"].alias("r")),
        lambda s: s["l"] * F.lit(b).cast("bigint") + s["r"],
    )


def _walk(x: Column, rows: int, step) -> Column:
    inside = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALKS)), step(x),
        lambda at, _: F.when(at < rows, at).otherwise(step(at)),
    )
    return F.when(inside < rows, inside).otherwise(F.raise_error(F.lit("the walk has not ended")).cast("bigint"))


def permuted(row: Column, rows: int, seed: int = 7) -> Column:
    """The place of global row ``row`` in the shuffle of ``rows`` rows: a bijection."""
    return _walk(row, rows, lambda x: _once(x, rows, seed))


def row_at(place: Column, rows: int, seed: int = 7) -> Column:
    """The global row that :func:`permuted` puts at ``place``."""
    return _walk(place, rows, lambda x: _once_back(x, rows, seed))


def global_rows(df: DataFrame, key: str, ties: list[str], rows: int, name: str = "row") -> DataFrame:
    """Number the rows from 0 by ``key`` (nulls last), then ``ties``, without sorting them in one task."""
    cut = df.withColumn("__cut", range_chunk(df, key, rows, CHUNK_ROWS)).withColumn(
        "__cut", F.when(F.col("__cut") < 0, F.lit(1 << 30)).otherwise(F.col("__cut"))
    )
    before = carried(cut, [], "__cut", {"__before": F.lit(1)})
    inside = Window.partitionBy("__cut").orderBy(F.col(key).asc_nulls_last(), *ties)
    return (
        cut.join(before, "__cut")
        .withColumn(name, F.col("__before") + F.row_number().over(inside) - 1)
        .drop("__cut", "__before")
    )


def shard_rows(
    docs: DataFrame, shards: int, *, id_col: str = "doc_id", text_col: str = "text", seed: int = 7
) -> DataFrame:
    """Deal documents to ``shards`` by law ``rows``: counts are at most one apart.

    Rows are numbered by id (nulls last; ties by checksum, then size; rows
    equal in all three are interchangeable), the number goes through a Feistel
    permutation of the row numbers, and place ``p`` is slot ``p / shards`` of
    shard ``p % shards``. Whoever knows the row count and the seed can compute
    both from a row number, and back by :func:`row_at`. Null text has size 16
    and checksum 0, as empty text. An empty table gives no rows. Other columns
    are left out.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 16).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows = docs.count()
    numbered = global_rows(base, "doc_id", ["text_crc32", "size"], rows)
    place = permuted(F.col("row"), rows, seed) if rows else F.col("row")
    return numbered.withColumn("place", place).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        (F.col("place") % shards).cast("int").alias("shard"),
        F.floor(F.col("place") / shards).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


# The checksum is a fold over the bytes with the usual reflected table.
SHARD_SQL = """
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8),
      lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) AS c
    FROM (SELECT unnest(range(256)) AS i))),
base AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 16 AS size,
    xor(4294967295, list_reduce(
      list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295)) AS text_crc32
  FROM documents, crc_table),
numbered AS (
  SELECT *, row_number() OVER (ORDER BY doc_id NULLS LAST, text_crc32, size) - 1 AS row FROM base),
n AS (SELECT count(*) AS n, (ceil(sqrt(count(*))))::BIGINT AS a FROM documents),
dims AS (SELECT n, a, (n + a - 1) // a AS b FROM n),
walk AS (
  SELECT row, row // b AS l, row % b AS r, 0 AS step, FALSE AS done FROM numbered, dims
  UNION ALL
  SELECT row,
    CASE WHEN step % 6 = 0 AND step > 0 AND l * b + r < n THEN l ELSE r END,
    CASE WHEN step % 6 = 0 AND step > 0 AND l * b + r < n THEN r
      ELSE (l + ('0x' || substr(md5(r || ':7-' || (step % 6)), 1, 8))::BIGINT)
        % CASE WHEN step % 2 = 0 THEN a ELSE b END END,
    step + 1,
    step % 6 = 0 AND step > 0 AND l * b + r < n
  FROM walk, dims WHERE NOT done),
placed AS (SELECT row, l * b + r AS place FROM walk, dims WHERE done)
SELECT doc_id, size, text_crc32, 'rows' AS law, (place % 40)::INTEGER AS shard, place // 40 AS slot,
  NULL::INTEGER AS grown_shard
FROM numbered JOIN placed USING (row)
"""


@query("op7_sharding", SHARD_SQL)
def sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"), 40)
