"""Expressions over numeric array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(vec: Column) -> Column:
    return vec.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(vec: Column) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x * x))


def l2_normalise(vec: Column, eps: float = 1e-12) -> Column:
    """Unit-length vector; a zero vector stays zero."""
    length = F.greatest(norm(vec), F.lit(eps))
    return F.transform(vec, lambda x: x / length)


def normalise(vec: Column, mean: float = 0.485, std: float = 0.229, scale: float = 1.0) -> Column:
    return F.transform(vec, lambda x: (x * F.lit(scale) - F.lit(mean)) / F.lit(std))


def argmax_label(scores: Column) -> Column:
    """Position of the largest score, the first one on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def random_bit(seed: int, *keys: Column, p: float = 0.5) -> Column:
    """A repeatable coin: true with probability ``p`` (in steps of 1/65536)."""
    text = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])
    draw = F.conv(F.substring(F.md5(text), 1, 4), 16, 10).cast("bigint")
    return draw < int(round(p * 65536))


def flip(vec: Column, coin: Column, width: int | None = None) -> Column:
    """Mirror left to right where ``coin`` holds.

    ``width`` is the row length of a flattened picture; without it the whole
    array is one row.
    """
    if width is None:
        mirrored = F.reverse(vec)
    else:
        mirrored = F.transform(
            vec,
            lambda _, i: F.get(vec, (F.floor(i / width) * width + width - 1 - i % width).cast("int")),
        )
    return F.when(coin, mirrored).otherwise(vec)


def mark_centre(vec: Column, width: int, value: float = 0.0) -> Column:
    """Set the middle column of a flattened picture to ``value``."""
    return F.transform(vec, lambda v, i: F.when(i % width == width // 2, F.lit(value)).otherwise(v))


def draw_columns(vec: Column, xs: Column, width: int, value: float = 0.0) -> Column:
    """Set every column listed in ``xs`` of a flattened picture to ``value``."""
    return F.transform(
        vec, lambda v, i: F.when(F.array_contains(xs, i % width), F.lit(value)).otherwise(v)
    )


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))
