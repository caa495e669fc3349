"""Count windows, packed sequences, neighbours, batches and running means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandcut.operators.ordering import (
    CHUNK_BITS,
    HOT_ROWS,
    as_list,
    hot_parts,
    neighbours,
    prefix_sums,
    running_position,
    with_neighbours,
)


def count_windows(
    df: DataFrame,
    order: str,
    *,
    size: int = 80,
    step: int = 40,
    part: str | Sequence[str] | None = None,
    include_last: bool = False,
    bits: int = CHUNK_BITS,
) -> DataFrame:
    """Assign rows to overlapping windows of ``size`` rows, ``step`` apart.

    Adds ``window_id`` and ``item_no`` (0-based place in the window). A window
    must end before the last row; ``include_last`` also admits one that ends
    exactly with it. Without ``part`` windows run over the whole table.
    """
    part = as_list(part)
    placed = prefix_sums(
        df, part, order, {"__pos": F.lit(1).cast("bigint")}, totals=True, bits=bits
    )
    pos, n = F.col("__pos"), F.col("__pos_total")
    first = F.greatest(F.floor((pos - size) / step) + 1, F.lit(0))
    room = n - size - (0 if include_last else 1)
    last = F.least(F.floor(pos / step), F.floor(room / step))
    wins = F.when(last >= first, F.sequence(first, last))
    out = placed.withColumn("window_id", F.explode(wins))
    return out.withColumn("item_no", F.col("__pos") - F.col("window_id") * step).drop("__pos", "__pos_total")


def sequence_pack(windows: DataFrame, cols: Sequence[str], *, part: str | Sequence[str] | None = None) -> DataFrame:
    """One row per window with its items, in order, as an array of structs."""
    keys = [*as_list(part), "window_id"]
    packed = windows.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("item_no", *cols))).alias("__items")
    )
    items = F.transform("__items", lambda s: F.struct(*[s[c].alias(c) for c in cols]))
    return packed.select(*keys, items.alias("items"))


def flatten_sequences(packed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Back to one row per item, with ``item_no``."""
    rows = packed.select(*keys, F.posexplode("items").alias("item_no", "__item"))
    return rows.select(*keys, F.col("item_no").cast("bigint").alias("item_no"), "__item.*")


def collect_columns(
    df: DataFrame, part: str | Sequence[str], order: str, cols: Sequence[str], *, page: int = 4096
) -> DataFrame:
    """Rows to column lists, in order: one array per column.

    A group is paged by its integer ``order`` column, ``page`` values per row,
    so no list outgrows a row; a group shorter than that has page 0 only.
    """
    part = as_list(part)
    paged = df.withColumn("page_no", F.floor(F.col(order) / page))
    listed = paged.groupBy(*part, "page_no").agg(
        F.sort_array(F.collect_list(F.struct(order, *cols))).alias("__rows")
    )

    def column(c: str) -> Column:
        return F.transform("__rows", lambda s: s[c]).alias(c)

    return listed.select(*part, "page_no", *[column(c) for c in cols])


def context_features(
    df: DataFrame,
    part: str | Sequence[str] | None,
    order: str,
    value: str,
    k: int = 2,
    *,
    fill: Column | None = None,
    bits: int = CHUNK_BITS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add the ``k`` values before and after each slice; ``fill`` (0) beyond the ends.

    Partitions of up to ``hot_rows`` rows take one ordinary window. The rows of
    larger ones are numbered and looked at chunk by chunk.
    """
    part, fill = as_list(part), F.lit(0) if fill is None else fill
    if not part:
        placed = running_position(df, None, order, "__at", bits=bits)
        return neighbours(placed, None, "__at", [value], k, fill=fill, bits=bits).drop("__at")
    along = Window.partitionBy(*part).orderBy(order)
    hot = hot_parts(df, part, hot_rows)
    if hot is None:
        return with_neighbours(df, along, [value], k, fill)
    marked = hot.mark(df)
    placed = running_position(marked.where("__hot").drop("__hot"), part, order, "__at", bits=bits, hot_rows=None)
    large = neighbours(placed, part, "__at", [value], k, fill=fill, bits=bits).drop("__at")
    small = with_neighbours(marked.where("__hot IS NULL").drop("__hot"), along, [value], k, fill)
    return small.unionByName(large)


def context_vectors(
    df: DataFrame, part: str | Sequence[str] | None, order: str, vec: str, dim: int, k: int = 1, **options
) -> DataFrame:
    """Add ``context``: each encoding between its ``k`` neighbours on both sides.

    Zeros stand in beyond the ends. This is what a classifier that looks both
    ways along a line is given.
    """
    zeros = F.array_repeat(F.lit(0.0), dim).cast(df.schema[vec].dataType)
    seen = context_features(df, part, order, vec, k, fill=zeros, **options)
    before = [F.col(f"{vec}_prev{i}") for i in range(k, 0, -1)]
    after = [F.col(f"{vec}_next{i}") for i in range(1, k + 1)]
    return seen.select(*df.columns, F.concat(*before, F.col(vec), *after).alias("context"))


def batch_ids(df: DataFrame, order: str, size: int = 256, *, bits: int = CHUNK_BITS) -> DataFrame:
    """Number consecutive batches of ``size`` rows; the last may be short."""
    placed = running_position(df, None, order, "__at", bits=bits)
    return placed.withColumn("batch_id", F.floor(F.col("__at") / size)).drop("__at")


def running_mean(
    df: DataFrame, order: str, value: Column, name: str, *, part: str | Sequence[str] | None = None,
    bits: int = CHUNK_BITS,
) -> DataFrame:
    """Mean of ``value`` over all rows up to and including the current one."""
    sums = {"__sum": value.cast("double"), "__n": F.lit(1).cast("bigint")}
    summed = prefix_sums(df, part, order, sums, inclusive=True, bits=bits)
    return summed.withColumn(name, F.col("__sum") / F.col("__n")).drop("__sum", "__n")
