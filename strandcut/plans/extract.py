"""From line images to slices, in the three ways lines are cleaned."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandcut.functions import geometry as G
from strandcut.operators import pixels as P
from strandcut.operators.slicing import drop_tall, number_images


def corpus_slices(lines: DataFrame) -> DataFrame:
    """Low lines, blank ends cut off, padded to slice height: gray slices."""
    return P.slice_pixels(P.strip_and_pad(drop_tall(lines, "h")))


def upload_slices(lines: DataFrame) -> DataFrame:
    """Lines of any height cut or padded to slice height: gray slices."""
    return P.slice_pixels(P.crop_and_pad(lines))


def directory_slices(lines: DataFrame, *, side_pad: int = G.SIDE_PAD) -> DataFrame:
    """Lines at model height, smoothed, black and white, white on both sides.

    Lines are brought to one slice height at the end, so that any slice fits
    the model. Cleaning a line is one Python step, cutting it another.
    """
    sides = partial(P.pad, top=0, bottom=0, left=side_pad, right=side_pad)
    clean = P.compose(P.to_line_height, P.blur, P.threshold, P.to_slice_height, sides)
    return P.slice_pixels(P.map_images(lines, clean))


def number_lines(lines: DataFrame, *, side_pad: int = G.SIDE_PAD) -> DataFrame:
    """Add ``first_no`` (number of the line's first slice in its directory) and ``line_w``.

    Numbers come from the widths, a few bytes per image. Give this lines that
    were written to Parquet: reading widths then reads no pixels. Slices inherit
    the columns of their line, and ``first_no + slice_no`` is a slice's number.
    """
    firsts = number_images(lines, "dir", "image_id", "w", pad=side_pad)
    firsts = firsts.select("image_id", "first_no", F.col("w").alias("line_w"))
    return lines.join(firsts, "image_id")


def with_index(slices: DataFrame) -> DataFrame:
    return slices.withColumn("idx", F.col("first_no") + F.col("slice_no"))
