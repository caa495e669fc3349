"""The compact label notation, read by column expressions.

A row names slice indexes: ``N``, ``N+`` (one plus sign per further index),
``N+M`` (the M indexes after N as well), ``N-M`` (inclusive range). A trailing
``*`` marks the row as important.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_row(raw: Column) -> Column:
    """Drop line breaks, then tabs, at both ends. Other blanks stay."""
    return F.trim(F.trim(raw, F.lit("\n")), F.lit("\t"))


def numbers(spec: Column) -> Column:
    found = F.regexp_extract_all(spec, F.lit(r"([0-9]+)"), F.lit(1))
    return F.transform(found, lambda x: x.cast("bigint"))


def symbols(spec: Column) -> Column:
    return F.regexp_replace(spec, r"[0-9]+", "")


def plus_count(spec: Column) -> Column:
    return F.length(spec) - F.length(F.replace(spec, F.lit("+"), F.lit("")))


# All well-formed rows: numbers may stand anywhere among the signs, so next to
# the usual 35, 35++, 35+3, 35-40 and 35* the pattern admits +35 or 12*34.
WELL_FORMED = (
    r"^(?:(?=[*]*[0-9])[0-9*]+"
    r"|[+]*[0-9]+[+]+[*]*|[+]+[*]*[0-9]+[*]*"
    r"|[0-9]+[+-][*]*[0-9]+[*]*|[+-][*]*[0-9]+[*]+[0-9]+[*]*)$"
)
# Values of 10 ** 18 and more may not fit a bigint; zeros in front do not count.
TOO_LONG = r"[1-9][0-9]{18}"
# Longest stretch of indexes held in one array.
BLOCK = 1 << 16


def well_formed(spec: Column) -> Column:
    """One pattern match; the cheap test for the hot path."""
    return spec.rlike(WELL_FORMED) & ~spec.rlike(TOO_LONG) & ~F.endswith(spec, F.lit("\n"))


def label_error(spec: Column) -> Column:
    """Null for a well-formed row, else the name of the broken rule."""
    n, sym, plus = F.size(F.regexp_extract_all(spec, F.lit(r"([0-9]+)"), F.lit(1))), symbols(spec), plus_count(spec)
    return (
        F.when(spec.rlike(r"[^0-9*+\-]"), F.lit("character"))
        .when(spec.rlike(TOO_LONG), F.lit("number_too_long"))
        .when(n == 0, F.lit("no_number"))
        .when(~sym.rlike(r"^([+]+|-)?[*]*$"), F.lit("symbol_order"))
        .when(F.contains(sym, F.lit("-")) & (n != 2), F.lit("range_needs_two"))
        .when((plus > 0) & (n > 2), F.lit("too_many_numbers"))
        .when((plus > 1) & (n == 2), F.lit("double_plus"))
    )


def expand_label_spec(spec: Column, nums: Column | None = None) -> Column:
    """Array of the indexes a well-formed row names.

    A reversed range names its two ends, as does any pair without ``+``/``-``.
    ``nums`` is a column that already holds the row's numbers.
    """
    nums = numbers(spec) if nums is None else nums
    plus, first, second = plus_count(spec), F.get(nums, F.lit(0)), F.get(nums, F.lit(1))
    return (
        F.when((plus > 0) & (F.size(nums) == 1), F.sequence(first, first + plus))
        .when(plus > 0, F.sequence(first, first + second))
        .when(F.contains(spec, F.lit("-")) & (second >= first), F.sequence(first, second))
        .otherwise(nums)
    )


def label_blocks(spec: Column, nums: Column | None = None) -> Column:
    """The indexes a row names as ``[low, high]`` stretches of at most ``BLOCK``.

    The form to explode: however long a range is, no row holds all of it.
    """
    nums = numbers(spec) if nums is None else nums
    first, second = F.get(nums, F.lit(0)), F.get(nums, F.lit(1))
    low, high = label_bounds(spec, nums)
    ranged = (plus_count(spec) > 0) | (F.contains(spec, F.lit("-")) & (second >= first))
    step = F.lit(BLOCK).cast("bigint")
    cut = F.transform(
        F.sequence(low, high, step),
        lambda s: F.struct(s.alias("low"), F.least(s + BLOCK - 1, high).alias("high")),
    )
    single = F.transform(nums, lambda n: F.struct(n.alias("low"), n.alias("high")))
    return F.when(ranged, cut).otherwise(single)


def label_bounds(spec: Column, nums: Column | None = None) -> tuple[Column, Column]:
    """Smallest and largest index a row names, without expanding it."""
    nums = numbers(spec) if nums is None else nums
    plus, first, second = plus_count(spec), F.get(nums, F.lit(0)), F.get(nums, F.lit(1))
    high = (
        F.when((plus > 0) & (F.size(nums) == 1), first + plus)
        .when(plus > 0, first + second)
        .otherwise(F.array_max(nums))
    )
    low = F.when(plus > 0, first).otherwise(F.array_min(nums))
    return low, high


def label_flag(spec: Column) -> Column:
    return F.contains(spec, F.lit("*"))
