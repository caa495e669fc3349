"""Registration of queries and the inputs they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SEED = 42
CHARACTER_TYPES = ("view", "click", "signup")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_separator() -> Column:
    return F.when(F.col("event_type").isin(*CHARACTER_TYPES), 0).otherwise(1)


def labelled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as labelled slices: a user is a line, the event number the position."""
    return table(spark, sf_dir, "events").select("user_id", "event_id", is_separator().alias("label"))


# The same rows for the SQL side.
EVENTS_SQL = (
    "(SELECT user_id, event_id, "
    "CASE WHEN event_type IN ('view', 'click', 'signup') THEN 0 ELSE 1 END AS label FROM events)"
)
