"""Helpers shared by the operators: stored tables, chunks, carried sums."""

from __future__ import annotations

import math
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandcut.session import shared_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word ends at one of these six characters.
WORD = r"[^\x20\x09-\x0D]+"
KEY_BITS = 60


#: With this setting a query's shuffle files go when the query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again.

    Cuts the lineage in a way that survives lost executors. Nothing reads the
    shuffle files of the write again, so they go with it. The table's files
    lie in one folder per application and may go when it has ended.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strandcut-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Remove the files of tables made by :func:`stored` that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(_paths.pop(df))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def count_words(text: Column) -> Column:
    """How many runs of characters other than the six white ones; null counts 0."""
    # A word is counted where its first character is: white to a blank, words to one letter.
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def shuffle_key(*cols: Column) -> Column:
    """A repeatable 60-bit hash of the columns, nulls included."""
    parts = [F.coalesce(c.cast("string"), F.lit("\x00")) for c in cols]
    return F.conv(F.substring(F.md5(F.concat_ws("\x01", *parts)), 1, KEY_BITS // 4), 16, 10).cast("bigint")


def bits_for(rows: int, per_chunk: int, most: int = 20) -> int:
    """Bits of a hash that leave about ``per_chunk`` rows to each value."""
    return min(most, max(0, math.ceil(math.log2(max(1, rows) / per_chunk))))


def range_chunk(df: DataFrame, col: str, rows: int, per_chunk: int, most_bits: int = 12) -> Column:
    """A chunk number that never falls along the integer column ``col``; null gives -1.

    The bounds are approximate quantiles, so chunks are nearly even whatever
    the values are. At most ``2**most_bits`` bounds reach the driver; beyond
    ``per_chunk << most_bits`` rows the chunks grow. Copies of one value share
    a chunk.
    """
    bits = bits_for(rows, per_chunk, most_bits)
    if bits == 0:
        return F.when(F.col(col).isNull(), -1).otherwise(0)
    n = 1 << bits
    found = df.agg(F.percentile_approx(col, [i / n for i in range(1, n)], 10 * n).alias("b")).first()["b"]
    if not found:
        return F.lit(-1)
    bounds = F.array(*[F.lit(int(b)).cast("bigint") for b in found])
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(bits))])
    # Binary search: how many bounds the value has reached.
    place = F.aggregate(
        steps, F.lit(0), lambda at, step: F.when(F.get(bounds, at + step - 1) <= F.col(col), at + step).otherwise(at)
    )
    return F.when(F.col(col).isNull(), -1).otherwise(place)


def carried(df: DataFrame, part: list[str], chunk: str, sums: dict[str, Column]) -> DataFrame:
    """For each ``part`` and ``chunk``: what the chunks before it add up to.

    One narrow row per chunk is windowed; the data itself is only summed up.
    """
    per = df.groupBy(*part, chunk).agg(*[F.sum(e).alias(n) for n, e in sums.items()])
    before = Window.partitionBy(*part).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    return per.select(*part, chunk, *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in sums])
