"""Runs of character slices merged into spans, and cut positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandcut.operators.ordering import CARRY_BITS, HOT_ROWS, as_list, chunk_of, hot_parts, join_parts, scan

CHUNK_BITS = 20


def char_spans(
    df: DataFrame,
    part: str | Sequence[str],
    order: str,
    label: str,
    pos: str,
    *,
    bits: int = CHUNK_BITS,
    hot_rows: int = HOT_ROWS,
    link_bits: int = CARRY_BITS,
) -> DataFrame:
    """Spans ``[beg, end]`` of label-0 runs along ``order`` within ``part``.

    A run opens at the position of the slice before it (0 when it is the first
    slice) and closes at the position of the first slice after it (its own
    last position when nothing follows). ``order`` must be an integer that is
    unique within ``part``.

    A partition of up to ``hot_rows`` rows is read in one go. Larger ones are
    cut into chunks of ``2**bits`` order values; what a chunk needs from the
    others (does a run reach into it, where was the last slice, where is the
    next separator) is one row per chunk; those rows are scanned ``2**link_bits`` at a
    time, level by level.
    """
    part = as_list(part)
    rows = df.select(
        *part,
        F.col(order).cast("bigint").alias("__ord"),
        (F.col(label) == 0).alias("__in"),
        F.col(pos).cast("bigint").alias("__pos"),
    )
    hot = hot_parts(df.select(*part), part, hot_rows)
    if hot is None:
        rows = rows.withColumn("__chunk", F.lit(None).cast("bigint"))
    else:
        rows = hot.mark(rows).select("*", F.when(F.col("__hot"), chunk_of("__ord", bits)).alias("__chunk")).drop("__hot")
    keys = [*part, "__chunk"]
    inside = Window.partitionBy(*keys).orderBy("__ord")
    stepped = rows.withColumns(
        {"__was_in": F.lag("__in").over(inside), "__was_pos": F.lag("__pos").over(inside)}
    ).withColumn("__opens", (F.col("__in") & ~F.coalesce("__was_in", F.lit(False))).cast("bigint"))
    stepped = stepped.withColumn(
        "__run", F.sum("__opens").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    )

    # A run row covers its label-0 slices and the separators up to the next run;
    # run 0 holds separators that lead the chunk. Keys extend the window's keys,
    # so this needs no further shuffle.
    runs = stepped.groupBy(*keys, "__run").agg(
        F.min_by("__was_pos", "__ord").alias("__before"),
        F.min_by(F.col("__in") & F.col("__was_in").isNull(), "__ord").alias("__leads"),
        F.min_by("__pos", F.when(~F.col("__in"), F.col("__ord"))).alias("__close"),
        F.max_by("__pos", "__ord").alias("__last"),
    )
    whole = runs.where(F.col("__run") > 0)
    if hot is None:
        return whole.select(
            *part, (F.col("__run") - 1).alias("span_no"), F.coalesce("__before", F.lit(0)).alias("beg"),
            F.coalesce("__close", "__last").alias("end"),
        )
    links = _chunk_links(runs.where(F.col("__chunk").isNotNull()), part, link_bits)
    whole = join_parts(whole, links, keys, nulls=hot.nulls)
    joined = F.coalesce("__joined", F.lit(False))
    return whole.where(~(F.col("__leads") & joined)).select(
        *part,
        (F.coalesce("__base", F.lit(0)) + F.col("__run") - 1 - joined.cast("bigint")).alias("span_no"),
        F.coalesce("__before", F.when(F.col("__leads"), F.col("__carry_pos")), F.lit(0)).alias("beg"),
        F.coalesce("__close", "__next_close", "__final_pos", "__last").alias("end"),
    )


def _chunk_links(runs: DataFrame, part: list[str], bits: int) -> DataFrame:
    """What each chunk of a large partition takes over from its other chunks.

    ``__joined``: its first run goes on from the chunk before. ``__carry_pos``:
    last position before it. ``__next_close``: first separator after it.
    ``__final_pos``: last position of the partition. ``__base``: spans opened
    before it. All are scans over the chunk rows, ``bits`` of their number at a time.
    """
    keys = [*part, "__chunk"]
    chunks = runs.groupBy(*keys).agg(
        F.max("__run").alias("__n"),
        F.max("__leads").alias("__leads_in"),
        F.min_by("__close", F.when(F.col("__close").isNotNull(), F.col("__run"))).alias("__first_close"),
        F.max_by(F.col("__close").isNull(), "__run").alias("__ends_in"),
        F.max_by("__last", "__run").alias("__last_pos"),
    )
    # A null position is a value like others, so it travels in a struct.
    chunks = scan(
        chunks, part, "__chunk", {"__left": ("near", F.struct("__ends_in", "__last_pos"))},
        {"__next_close": ("near", F.col("__first_close")), "__end": ("far", F.struct("__last_pos"))}, bits=bits,
    )
    joined = F.col("__leads_in") & F.coalesce(F.col("__left")["__ends_in"], F.lit(False))
    chunks = chunks.withColumn("__joined", joined)
    opened = F.col("__n") - F.col("__joined").cast("bigint")
    chunks = scan(chunks, part, "__chunk", {"__base": ("sum", opened)}, bits=bits)
    return chunks.select(
        *keys, "__joined", F.col("__left")["__last_pos"].alias("__carry_pos"), "__next_close",
        F.coalesce(F.col("__end")["__last_pos"], "__last_pos").alias("__final_pos"), "__base",
    )


def cut_positions(df: DataFrame, label: str, keep: Sequence[str]) -> DataFrame:
    """Rows that separate two characters, with the columns asked for."""
    return df.where(F.col(label) == 1).select(*keep)


def spans_json(
    spans: DataFrame, part: str | Sequence[str], *, page: int = 4096, images: DataFrame | None = None
) -> DataFrame:
    """JSON list of ``[beg,end]`` pairs per image, in span order.

    An ordinary line fills page 0 only. Longer lists go on in further pages of
    ``page`` spans, so that no row collects an unbounded group. With
    ``images``, those of them that have no span get an empty list.
    """
    part = as_list(part)
    paged = spans.withColumn("page_no", F.floor(F.col("span_no") / page))
    listed = paged.groupBy(*part, "page_no").agg(
        F.sort_array(F.collect_list(F.struct("span_no", "beg", "end"))).alias("__items")
    )
    pairs = F.transform("__items", lambda s: F.array(s["beg"], s["end"]))
    out = listed.select(*part, "page_no", F.to_json(pairs).alias("spans_json"))
    if images is None:
        return out
    none = images.select(*part).distinct().join(spans.select(*part), part, "left_anti")
    return out.unionByName(none.select(*part, F.lit(0).cast("bigint").alias("page_no"), F.lit("[]").alias("spans_json")))
