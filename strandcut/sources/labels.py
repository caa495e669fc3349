"""Label files: one small text file per directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandcut.functions.names import dir_below
from strandcut.sources.files import scan_files

LABEL_FILE = "labels.txt"


def scan_label_lines(spark: SparkSession, root: str, file_name: str = LABEL_FILE) -> DataFrame:
    """Rows of each directory's label file: ``dir``, ``line_at``, ``raw``.

    ``line_at`` orders the rows of a file: the offset of the file block a row
    was read from, then its place in the task that read it. Files are read by
    the line, so a long one may be split over tasks. ``dir`` is relative to
    ``root``. An empty file is one row with a null ``raw``: it is there, and
    labels nothing.
    """
    rows = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", file_name)
        .text(root)
        .select("value", "_metadata.file_path", "_metadata.file_block_start")
        .withColumn("row", F.monotonically_increasing_id())
    )
    lines = rows.select(
        dir_below(F.col("file_path"), root, encoded=True).alias("dir"),
        F.struct(F.col("file_block_start").alias("block"), "row").alias("line_at"),
        F.col("value").alias("raw"),
    )
    empty = scan_files(spark, root, file_name).where(F.col("length") == 0)
    first = F.struct(F.lit(0).cast("bigint").alias("block"), F.lit(0).cast("bigint").alias("row"))
    return lines.unionByName(empty.select("dir", first.alias("line_at"), F.lit(None).cast("string").alias("raw")))


def scan_predicted(spark: SparkSession, root: str, file_name: str = "predict_labels.txt") -> DataFrame:
    """Predicted slice indexes: ``dir``, ``idx``."""
    rows = scan_label_lines(spark, root, file_name).where(F.trim("raw") != "")
    return rows.select("dir", F.trim("raw").cast("bigint").alias("idx"))
