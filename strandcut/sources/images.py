"""Line images and slice files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandcut.functions.names import dir_below
from strandcut.operators.pixels import gray_lines
from strandcut.sources.files import scan_files

IMAGE_SCHEMA = T.StructType([
    T.StructField(
        "image",
        T.StructType([
            T.StructField("origin", T.StringType()),
            T.StructField("height", T.IntegerType()),
            T.StructField("width", T.IntegerType()),
            T.StructField("nChannels", T.IntegerType()),
            T.StructField("mode", T.IntegerType()),
            T.StructField("data", T.BinaryType()),
        ]),
    )
])


def flatten_images(raw: DataFrame, root: str) -> DataFrame:
    """Fields of Spark's image struct under the names of the line table."""
    origin = F.col("image.origin")
    return raw.select(
        origin.alias("image_id"),
        dir_below(origin, root, encoded=True).alias("dir"),
        F.col("image.height").alias("h"),
        F.col("image.width").alias("w"),
        F.col("image.nChannels").alias("nChannels"),
        F.col("image.data").alias("data"),
    )


def _decoded(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """All images under ``path``; those that cannot be decoded have -1 channels."""
    raw = (
        spark.read.format("image")
        .option("pathGlobFilter", f"{prefix}*.png")
        .option("recursiveFileLookup", "true")
        .option("dropInvalid", "false")
        .load(path)
    )
    return flatten_images(raw, path)


def bad_images(spark: SparkSession, path: str, *, prefix: str = "") -> DataFrame:
    """``image_id, dir`` of the files that cannot be decoded: the quarantine table of the line scans."""
    return _decoded(spark, path, prefix).where(F.col("nChannels") == -1).select("image_id", "dir")


def scan_raw_lines(
    spark: SparkSession, path: str, *, prefix: str = "", max_h: int | None = None, spread: bool = True,
    strict: bool = False,
) -> DataFrame:
    """Line images under ``path`` as Spark decodes them; ``dir`` is their folder relative to it.

    ``prefix`` limits the file names. ``max_h`` drops tall lines before any
    Python step. ``spread`` shuffles the lines by id, since files of a folder
    tend to arrive in few input partitions. Files that cannot be decoded are
    left to :func:`bad_images`; with ``strict`` the first of them fails the job.
    """
    good = F.col("nChannels") != -1
    if strict:
        fail = F.raise_error(F.concat(F.lit("bad image: "), F.col("image_id")))
        good = F.when(good, F.lit(True)).otherwise(fail.cast("boolean"))
    flat = _decoded(spark, path, prefix).where(good)
    if max_h is not None:
        flat = flat.where(F.col("h") < max_h)
    return flat.repartition("image_id") if spread else flat


def scan_lines(spark: SparkSession, path: str, **options) -> DataFrame:
    """Line images under ``path`` as gray pixels; options as in :func:`scan_raw_lines`."""
    return gray_lines(scan_raw_lines(spark, path, **options))


def scan_uploads(spark: SparkSession, landing_dir: str, **options) -> DataFrame:
    """Uploaded images that landed as files; options as in :func:`scan_raw_lines`."""
    return scan_lines(spark, landing_dir, **options)


def scan_slice_files(spark: SparkSession, root: str) -> DataFrame:
    """Slice files of every directory, empty ones too: ``dir`` (relative to ``root``), ``path``, ``length``."""
    return scan_files(spark, root, "word*.png").select("dir", "path", "length")
