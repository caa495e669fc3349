"""Newly landed predictions or images to spans.

A landed file holds whole images, so every micro-batch is complete in itself:
no state and no watermark, the batch operator is simply applied to it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from strandcut.operators.pixels import gray_lines
from strandcut.operators.spans import char_spans
from strandcut.sources.images import IMAGE_SCHEMA, flatten_images


def read_landing(
    spark: SparkSession, path: str, schema: T.StructType, *, fmt: str = "parquet", max_files: int | None = None
) -> DataFrame:
    """Stream of the files that land under ``path`` (a folder or a glob)."""
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def read_landing_lines(spark: SparkSession, path: str, *, max_files: int | None = None) -> DataFrame:
    """Stream of landed line images as gray pixels."""
    raw = read_landing(spark, path, IMAGE_SCHEMA, fmt="image", max_files=max_files)
    return gray_lines(flatten_images(raw, path))


def detect_stream(
    stream: DataFrame,
    part: str | list[str],
    order: str,
    label: str,
    pos: str,
    out: str,
    checkpoint: str,
    *,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Append the spans of each micro-batch to the Parquet table ``out``.

    ``prepare`` turns a batch into labelled slices (scoring, for images). Each
    batch writes its own ``batch`` partition and overwrites it on a retry, so a
    batch run twice leaves one copy.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = prepare(batch) if prepare else batch
        spans = char_spans(rows, part, order, label, pos).withColumn("batch", F.lit(batch_id).cast("bigint"))
        (
            spans.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch")
            .parquet(out)
        )

    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()
