"""Chaining of user-supplied steps."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame

Step = Callable[[DataFrame], DataFrame]


def apply_steps(df: DataFrame, steps: Sequence[Step]) -> DataFrame:
    """Apply each ``DataFrame -> DataFrame`` step in turn; nothing runs yet."""
    return reduce(lambda d, step: d.transform(step), steps, df)
