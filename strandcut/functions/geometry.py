"""Extent arithmetic: slice positions, pads, crops and resize rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the slicing scheme.
SLICE_WIDTH = 16
SLICE_STEP = 4
SLICE_HEIGHT = 48
SIDE_PAD = 8
STRIP_MIN_INK = 5
STRIP_MARGIN = 16


def int_div(a: Column, b: int) -> Column:
    """Floor division that also holds for negative numbers."""
    return F.floor(a / F.lit(float(b)))


def slice_count(width: Column, size: int = SLICE_WIDTH, step: int = SLICE_STEP) -> Column:
    """Slices that fit wholly into ``width`` columns."""
    return F.greatest(F.lit(0).cast("bigint"), int_div(width - size, step) + 1)


def slice_numbers(width: Column, size: int = SLICE_WIDTH, step: int = SLICE_STEP) -> Column:
    """Array 0..n-1 of slice numbers; empty when the extent is too narrow."""
    n = slice_count(width, size, step)
    empty = F.array().cast("array<bigint>")
    return F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n - 1)).otherwise(empty)


def slice_mid(beg: Column, end: Column) -> Column:
    return int_div(beg + end, 2)


def to_origin_x(beg: Column, end: Column, width: Column, pad: int = SIDE_PAD) -> Column:
    """Middle of a slice in unpadded coordinates, clamped into the image."""
    mid = int_div(beg + end - 2 * pad, 2)
    return F.when(mid < 0, F.lit(0).cast("bigint")).when(mid >= width, width - 1).otherwise(mid)


def target_height(h: Column) -> Column:
    """Tall lines are brought to 128 rows, all others to 64."""
    return F.when(h > 80, F.lit(128)).otherwise(F.lit(64))


def pad_amounts(h: Column, w: Column, height: int = SLICE_HEIGHT, multiple: int = SLICE_STEP) -> dict[str, Column]:
    """White rows and columns to add; the odd remainder goes to bottom and right."""
    rows = F.lit(height) - h
    cols = F.pmod(F.lit(multiple) - F.pmod(w, F.lit(multiple)), F.lit(multiple))
    top, left = int_div(rows, 2), int_div(cols, 2)
    return {"top": top, "bottom": rows - top, "left": left, "right": cols - left}


def crop_amounts(h: Column, height: int = SLICE_HEIGHT) -> dict[str, Column]:
    """Rows to cut above and below a line taller than ``height``."""
    extra = F.greatest(h - height, F.lit(0))
    above = int_div(extra, 2)
    return {"above": above, "below": extra - above}
