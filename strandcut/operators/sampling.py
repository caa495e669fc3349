"""Caps, previews, splits, oversampling and repeatable shuffles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandcut.operators.ordering import as_list, hash_position
from strandcut.operators.selection import hash_quota, rows_at


def sample_cap(df: DataFrame, order: str | Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows in a fixed order."""
    return df.orderBy(*as_list(order)).limit(n)


def preview(df: DataFrame, order: str | Sequence[str], offset: int, n: int = 32) -> DataFrame:
    """``n`` rows from row ``offset`` on, for review."""
    return df.orderBy(*as_list(order)).offset(offset).limit(n)


def slice_at(df: DataFrame, order: Sequence[str], first: int, n: int = 1, **options: int) -> DataFrame:
    """Rows number ``first`` to ``first + n - 1`` in ``order``, with ``idx``.

    The range of the table that holds them is found by counting; nothing else is sorted.
    """
    return rows_at(df, order, first, n, **options)


def train_test_split(
    df: DataFrame, ids: str | Sequence[str], fraction: float, seed: int, **options: int
) -> DataFrame:
    """Add ``is_test``: exactly ``ceil(fraction * n)`` rows, by hash order of a unique id.

    Rows are counted by leading hash digits, deeper only where the quota ends, which
    gives the key of its last row; each row is then compared with that, in one scan without a shuffle.
    """
    return df.select(*df.columns, hash_quota(df, ids, seed, fraction, **options).alias("is_test"))


def oversample(df: DataFrame, flag: Column, times: int) -> DataFrame:
    """Repeat flagged rows ``times`` times (0 removes them); others stay once."""
    copies = F.when(flag, F.array_repeat(F.lit(1), times)).otherwise(F.array(F.lit(1)))
    return df.select(*df.columns, F.posexplode(copies).alias("copy_no", "__one")).drop("__one")


def shuffle_order(df: DataFrame, ids: str | Sequence[str], seed: int, name: str = "pos") -> DataFrame:
    """Add each row's place in a repeatable random order."""
    return hash_position(df, ids, seed, name)
