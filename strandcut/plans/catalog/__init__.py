"""The operators as queries over the given tables, each with its SQL twin."""

from strandcut.plans.catalog import (  # noqa: F401
    evaluation,
    labels,
    pictures,
    profiles,
    segments,
    sinks,
    vectors,
)
from strandcut.plans.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
