"""Scored slices to cuts, spans, painted lines and contact sheets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandcut.functions import geometry as G
from strandcut.functions import names
from strandcut.operators import pixels as P
from strandcut.operators import review, scoring
from strandcut.operators.spans import char_spans, cut_positions


# Fixed values the pixels are normalised with.
PIXEL_MEAN, PIXEL_STD = 0.485, 0.229


def score(slices: DataFrame, make_predict_fn: Callable) -> DataFrame:
    """Slices with their predicted ``label``; pixels leave the row once scored.

    Views are not flipped at random here, so a slice always gets the same score.
    """
    scored = scoring.score_pixels(slices, make_predict_fn, mean=PIXEL_MEAN, std=PIXEL_STD)
    return scoring.label_slices(scored).drop("px")


def line_spans(scored: DataFrame, *, side_pad: int = G.SIDE_PAD) -> DataFrame:
    """Character spans of each line, in its own columns, from its labelled slices; needs ``line_w``."""
    with_mid = scored.withColumn("mid", G.to_origin_x(F.col("beg"), F.col("end"), F.col("line_w"), side_pad))
    return char_spans(with_mid, ["dir", "image_id"], "slice_no", "label", "mid")


def line_cuts(scored: DataFrame, *, side_pad: int = G.SIDE_PAD) -> DataFrame:
    """Cut columns of each line in its own coordinates; needs ``line_w``."""
    x = G.to_origin_x(F.col("beg"), F.col("end"), F.col("line_w"), side_pad)
    return cut_positions(scored.withColumn("x", x), "label", ["dir", "image_id", "idx", "x"])


def overlays(lines: DataFrame, scored: DataFrame) -> DataFrame:
    """Lines with their cuts drawn in."""
    return P.draw_cuts(lines, line_cuts(scored).select("image_id", "x"))


def sheets(scored: DataFrame, lines: DataFrame) -> DataFrame:
    """Contact sheet rows of each directory of ``lines``, in slice order; one without slices gets an empty sheet."""
    named = scored.select(
        "dir",
        "idx",
        names.slice_name(F.col("idx"), F.col("label")).alias("name"),
        F.format_string("%04d", F.col("idx")).alias("idx_text"),
        F.format_string("%02d", F.col("label")).alias("type_text"),
    )
    laid_out = review.sheet_layout(named, "dir", "idx")
    sheet = review.contact_sheet(laid_out, "dir", "idx_text", "type_text", "name")
    return review.sheet_document(sheet, lines, "dir")
