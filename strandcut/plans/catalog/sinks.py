"""Sinks written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandcut.functions import names
from strandcut.operators.ordering import running_position
from strandcut.plans.catalog.registry import is_separator, query, table
from strandcut.session import shared_dir
from strandcut.sources import tables

# Event types are few directories with very many slices each.
TYPED_SQL = """
    (SELECT event_type AS dir, event_id, CASE WHEN value >= 20 THEN 1 ELSE 0 END AS label,
            row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS idx FROM events)
"""


def typed_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("dir"), "event_id", F.when(F.col("value") >= 20, 1).otherwise(0).alias("label")
    )
    return running_position(rows, "dir", "event_id", "idx")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("predicted_files", f"SELECT dir, idx::BIGINT AS idx FROM {TYPED_SQL} WHERE label = 1")
def predicted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index files per directory, one number per line; a rerun leaves none to a directory that lost its separators."""
    path = fresh_path(spark, "predicted_files")
    rows = typed_slices(spark, sf_dir).select("dir", "idx", "label")
    other = rows.where("idx = 0").withColumn("dir", F.lit("no: separators"))
    for label in (1, 0):
        run = rows.unionByName(other.withColumn("label", F.lit(label)))
        tables.write_predicted_index(run, path, "dir", "idx", "label")
    written = tables.read_lines(spark, path, "dir")
    return written.select("dir", F.col("value").cast("bigint").alias("idx"))


@query(
    "slice_files",
    f"""
    SELECT dir, idx::BIGINT AS idx, printf('word_seg_%04d_type_%02d.png', idx, label) AS file_name FROM {TYPED_SQL}
    """,
)
def slice_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices under the names they would have as files; a rerun replaces a directory's rows."""
    path = fresh_path(spark, "slice_files")
    rows = typed_slices(spark, sf_dir)
    tables.write_slices(rows.withColumn("label", F.lit(1)), path, "dir", "idx", "label")
    tables.write_slices(rows, path, "dir", "idx", "label")
    return tables.read_dataset(spark, path).select("dir", "idx", "file_name")


@query(
    "metric_log",
    """
    SELECT tag, date_diff('day', TIMESTAMP '2024-01-01', ts) AS step, round(avg(v), 5) AS value
    FROM (SELECT ts, unnest(['train/loss', 'train/acc']) AS tag,
                 unnest([value, CASE WHEN event_type IN ('view', 'click', 'signup') THEN 0.0 ELSE 1.0 END]) AS v
          FROM events)
    GROUP BY 1, 2
    """,
)
def metric_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tags appended one after the other to the same log."""
    path = fresh_path(spark, "metric_log")
    day = F.expr("timestampdiff(DAY, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts)").cast("bigint")
    rows = table(spark, sf_dir, "events").select(day.alias("step"), "value", is_separator().alias("y"))
    for tag, column in (("train/loss", "value"), ("train/acc", "y")):
        scalars = rows.groupBy("step").agg(F.avg(column).alias("value"))
        tables.log_metrics(scalars.select(F.lit(tag).alias("tag"), "step", "value"), path)
    return spark.read.parquet(path).withColumn("value", F.round("value", 5))


@query(
    "overlay_names",
    "SELECT page_id, replace(split_part(url, '?', 1) || '.png', '.png', '_infer.png') AS target FROM pages",
)
def overlay_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as pictures, under their overlay name."""
    picture = F.concat(F.split_part("url", F.lit("?"), F.lit(1)), F.lit(".png"))
    return table(spark, sf_dir, "pages").select("page_id", names.overlay_name(picture).alias("target"))
