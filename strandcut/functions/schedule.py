"""Decay curves over an epoch column."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def cosine_decay(epoch: Column, base: float, epochs: int) -> Column:
    return F.lit(base * 0.5) * (F.lit(1.0) + F.cos(F.lit(math.pi) * epoch / F.lit(float(epochs))))


def milestone_decay(epoch: Column, base: float, milestones: Sequence[int]) -> Column:
    """Divide by ten at every milestone reached."""
    passed = sum((F.when(epoch >= m, 1).otherwise(0) for m in milestones), F.lit(0))
    return F.lit(base) * F.pow(F.lit(0.1), passed)
