"""Column profiles of images in long form, thresholds and end stripping.

A profile has one row per image column, so after counting, a group is as long
as its image is wide; the hot group's raw rows are gone before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandcut.functions import geometry as G
from strandcut.operators.ordering import as_list

# The 5-tap binomial kernel and the gray levels of an 8-bit image.
KERNEL = (1, 4, 6, 4, 1)
LEVELS = 256


def ink_profile(
    points: DataFrame, image: str | Sequence[str], x: str, ink: Column, widths: DataFrame, width: str
) -> DataFrame:
    """Ink per image column ``x``, zero where nothing was drawn.

    ``points`` has a row per pixel (or event); ``widths`` gives each image's
    width. Returns image columns, ``x``, ``ink`` and ``width``.
    """
    image = as_list(image)
    counted = points.groupBy(*image, F.col(x).cast("bigint").alias("x")).agg(
        F.sum(ink.cast("bigint")).alias("ink")
    )
    grid = widths.select(
        *image,
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(width).cast("bigint") - 1)).alias("x"),
        F.col(width).cast("bigint").alias("width"),
    )
    return grid.join(counted, [*image, "x"], "left").withColumn("ink", F.coalesce("ink", F.lit(0).cast("bigint")))


def smooth_profile(profile: DataFrame, image: str | Sequence[str]) -> DataFrame:
    """Binomial 5-tap smoothing of a dense long profile with mirrored borders.

    The border value is not repeated: the tap before the first column is the
    second column, the one before that the third. Which neighbours are missing
    tells how far a column is from an end.
    """
    image = as_list(image)
    along = Window.partitionBy(*image).orderBy("x")
    near = profile.select(
        *image,
        "x",
        F.col("ink").alias("own"),
        *[F.lag("ink", k).over(along).alias(f"prev{k}") for k in (1, 2)],
        *[F.lead("ink", k).over(along).alias(f"next{k}") for k in (1, 2)],
    )

    def inner(side: str, other: str) -> Column:
        return F.coalesce(F.col(f"{side}1"), F.col(f"{other}1"), F.col("own"))

    def outer(side: str, other: str) -> Column:
        beside_end = F.when(F.col(f"{side}1").isNotNull(), F.col("own"))
        return F.coalesce(F.col(f"{side}2"), beside_end, F.col(f"{other}2"), F.col("own"))

    taps = (outer("prev", "next"), inner("prev", "next"), F.col("own"), inner("next", "prev"), outer("next", "prev"))
    total = sum((F.lit(float(k)) * t for k, t in zip(KERNEL, taps)), F.lit(0.0))
    return near.select(*image, "x", (total / F.lit(float(sum(KERNEL)))).alias("smooth"))


def strip_ends(
    profile: DataFrame,
    image: str | Sequence[str],
    *,
    min_ink: int = G.STRIP_MIN_INK,
    margin: int = G.STRIP_MARGIN,
) -> DataFrame:
    """First and last column to keep: the inked part plus a margin.

    On an all-blank line the scan from the left runs off the end, which leaves
    the last ``margin`` columns.
    """
    image = as_list(image)
    inked = F.when(F.col("ink") > min_ink, F.col("x"))
    ends = profile.groupBy(*image).agg(
        F.min(inked).alias("__b"), F.max(inked).alias("__e"), F.max("width").alias("__w")
    )
    first = F.coalesce("__b", "__w")
    last = F.coalesce(F.col("__e"), F.col("__w") - 1)
    return ends.select(
        *image,
        F.greatest(first - margin, F.lit(0)).alias("beg"),
        F.least(last + margin, F.col("__w") - 1).alias("end"),
    )


def _judged_levels(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """The histogram of each group (``__v``, ``__n``) with the group's ``threshold``."""
    level = F.col(value).cast("int").alias("__v")
    hist = df.groupBy(*group, level).agg(F.count(F.lit(1)).alias("__n"))
    every = Window.partitionBy(*group)
    upto = every.orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    mass = F.col("__n") * F.col("__v")
    sums = hist.select(
        *group,
        "__v",
        "__n",
        F.sum("__n").over(upto).cast("double").alias("__w0"),
        F.sum(mass).over(upto).cast("double").alias("__s0"),
        F.sum("__n").over(every).cast("double").alias("__w"),
        F.sum(mass).over(every).cast("double").alias("__s"),
    )
    gap = F.col("__s0") * F.col("__w") - F.col("__s") * F.col("__w0")
    spread = F.when(
        F.col("__w0") < F.col("__w"), gap * gap / (F.col("__w0") * (F.col("__w") - F.col("__w0")))
    ).otherwise(F.lit(0.0))
    best = F.max(F.struct(spread.alias("__var"), (-F.col("__v")).alias("__low"))).over(every)
    found = sums.select(*group, "__v", "__n", best.alias("__best"))
    threshold = F.when(F.col("__best")["__var"] > 0, -F.col("__best")["__low"]).otherwise(0)
    return found.select(*group, "__v", "__n", threshold.alias("threshold"))


def otsu(df: DataFrame, group: str | Sequence[str], value: str) -> DataFrame:
    """Gray level per group that maximises the variance between the two classes.

    Works on the 256-row histogram of each group. Ties go to the lowest level;
    a group with a single level gets 0.
    """
    group = as_list(group)
    return _judged_levels(df, group, value).groupBy(*group).agg(F.max("threshold").alias("threshold"))


def class_sizes(df: DataFrame, group: str | Sequence[str], value: str) -> DataFrame:
    """``threshold``, ``n_white`` and ``n_black`` per group, all from the histogram: rows are read once."""
    group = as_list(group)
    white = F.col("__v") > F.col("threshold")
    return _judged_levels(df, group, value).groupBy(*group, "threshold").agg(
        F.coalesce(F.sum(F.when(white, F.col("__n"))), F.lit(0)).alias("n_white"),
        F.coalesce(F.sum(F.when(~white, F.col("__n"))), F.lit(0)).alias("n_black"),
    )


def binarise(df: DataFrame, thresholds: DataFrame, group: str | Sequence[str], value: str) -> DataFrame:
    """Add ``binary``: 255 above the group's threshold, else 0."""
    return df.join(thresholds, as_list(group)).withColumn(
        "binary", F.when(F.col(value) > F.col("threshold"), 255).otherwise(0)
    )
