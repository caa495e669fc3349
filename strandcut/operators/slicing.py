"""Cutting extents, texts and arrays into overlapping slices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandcut.functions import geometry as G
from strandcut.operators.ordering import as_list, ordered_index, prefix_sums


def drop_tall(df: DataFrame, height: str, max_h: int = G.SLICE_HEIGHT) -> DataFrame:
    """Keep lines lower than ``max_h``; apply before any pixel work."""
    return df.where(F.col(height) < max_h)


def slice_windows(
    df: DataFrame,
    width: str | Column,
    *,
    size: int = G.SLICE_WIDTH,
    step: int = G.SLICE_STEP,
    pad: int = 0,
) -> DataFrame:
    """One row per slice with ``slice_no``, ``beg``, ``end`` (inclusive).

    ``pad`` columns are added on both sides of the extent first. A tail that is
    narrower than a slice gives none.
    """
    extent = (F.col(width) if isinstance(width, str) else width) + 2 * pad
    out = df.withColumn("slice_no", F.explode(G.slice_numbers(extent, size, step)))
    beg = F.col("slice_no") * step
    return out.withColumns({"beg": beg, "end": beg + (size - 1)})


def slice_text(
    df: DataFrame, text: str, *, size: int = G.SLICE_WIDTH, step: int = G.SLICE_STEP, listed: bool = False
) -> DataFrame:
    """One row per slice of a text, with ``slice_no`` and ``piece``.

    A single pass over the text: each match moves on by ``step`` characters and
    captures the ``size`` characters ahead, so long texts stay linear. With ``listed``
    the slices stay in the row of their text, as the list ``pieces``, which is null for a null text.
    """
    if step > size:
        raise ValueError("step must not exceed size")
    pieces = F.regexp_extract_all(F.col(text), F.lit(f"(?s)(?=(.{{{size}}})).{{1,{step}}}"), F.lit(1))
    other = [c for c in df.columns if c != text]
    if listed:
        return df.select(*other, pieces.alias("pieces"))
    return df.select(*other, F.posexplode(pieces).alias("slice_no", "piece"))


def slice_array(vec: Column, slice_no: Column, *, size: int = G.SLICE_WIDTH, step: int = G.SLICE_STEP) -> Column:
    return F.slice(vec, (slice_no * step + 1).cast("int"), F.lit(size))


def number_images(
    images: DataFrame, directory: str, path: str, width: str, *, pad: int = G.SIDE_PAD
) -> DataFrame:
    """Add ``first_no``: the directory-wide number of each image's first slice.

    Slices are counted from the widths, so numbering touches one row per image
    and never the slices: ``first_no + slice_no`` is the running number.
    """
    light = images.select(directory, path, width)
    indexed = ordered_index(light, [directory, path], "image_index")
    counts = {"first_no": G.slice_count(F.col(width) + 2 * pad)}
    return prefix_sums(indexed, directory, "image_index", counts)


def join_images(slices: DataFrame, images: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Slices with the columns of their image."""
    return slices.join(images, as_list(key))
