"""Prepared tables and the sinks."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.ml import Model
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandcut.functions import names
from strandcut.operators.spans import cut_positions

#: Folders below the path of a sink that is written run by run.
LINES, DIRS, COMMITS = "lines", "dirs", "commits"


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_dataset(df: DataFrame, path: str, *, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Prepared slices or lines as Parquet.

    With ``partition_by``, only the partitions present in ``df`` are replaced,
    so a rerun cleans up after itself and leaves other directories alone.
    """
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def _write_run(lines: DataFrame, dirs: DataFrame, path: str, directory: str, order: str, line: str) -> None:
    """Lines of the directories ``dirs``, as one run that counts as a whole or not at all.

    A run has its own folders below ``path``: text files whose parts, read by
    name, follow ``order`` (the range split spreads a large directory over
    several), and the list of its directories. The commit, one row in one file,
    comes last; until then :func:`read_lines` knows nothing of the run, so a job
    that fails midway leaves what was there. Nothing is deleted, listed or
    renamed by the driver.
    """
    spark, run = lines.sparkSession, uuid.uuid4().hex
    (
        lines.repartitionByRange(directory, order)
        .sortWithinPartitions(directory, order)
        .select(F.col(directory), F.col(line).alias("value"))
        .write.partitionBy(directory).text(f"{path}/{LINES}/run={run}")
    )
    dirs.select(F.col(directory).cast("string").alias("dir")).distinct().write.parquet(f"{path}/{DIRS}/run={run}")
    last = commits(spark, path).agg(F.coalesce(F.max("no"), F.lit(0))).first()[0]
    commit = spark.range(1).select(F.lit(run).alias("run"), F.lit(last + 1).cast("bigint").alias("no"))
    commit.coalesce(1).write.mode("append").parquet(f"{path}/{COMMITS}")


def commits(spark: SparkSession, path: str) -> DataFrame:
    """``run, no`` of every finished run under ``path``, numbered as they ended."""
    try:
        return spark.read.schema("run string, no bigint").parquet(f"{path}/{COMMITS}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "run string, no bigint")


def read_lines(spark: SparkSession, path: str, directory: str) -> DataFrame:
    """``value`` and the directory of the lines that stand: of each directory, those of its last finished run.

    A directory that its last run left without lines has none. Of runs that end
    at once the one of the larger id counts as the last.
    """
    done = commits(spark, path)
    if done.isEmpty():
        return spark.createDataFrame([], f"value string, {directory} string")
    listed = spark.read.schema("dir string, run string").parquet(f"{path}/{DIRS}")
    last = (
        listed.join(done, "run").groupBy("dir")
        .agg(F.max_by("run", F.struct("no", "run")).alias("__last"))
        .select(F.col("dir").alias("__dir"), "__last")
    )
    lines = spark.read.schema(f"value string, run string, {directory} string").text(f"{path}/{LINES}")
    ours = F.col(directory).eqNullSafe(F.col("__dir")) & (F.col("run") == F.col("__last"))
    return lines.join(last, ours).select("value", directory)


def write_predicted_index(df: DataFrame, path: str, directory: str, idx: str, label: str) -> None:
    """One slice number per line for the predicted separators of each directory.

    A directory of ``df`` without any has no lines afterwards, whatever a run
    before left; directories outside of ``df`` are left alone. ``df`` is
    computed once. :func:`read_lines` reads the result.
    """
    rows = df.select(directory, idx, label).persist(StorageLevel.DISK_ONLY)
    try:
        cuts = cut_positions(rows, label, [directory, idx]).withColumn("__line", F.col(idx).cast("string"))
        _write_run(cuts, rows, path, directory, idx, "__line")
    finally:
        rows.unpersist()


def write_slices(df: DataFrame, path: str, directory: str, idx: str, label: str) -> None:
    """All slices as rows, with the file name each would have had."""
    named = df.withColumn("file_name", names.slice_name(F.col(idx), F.col(label)))
    write_dataset(named, path, partition_by=[directory])


def write_overlays(lines: DataFrame, path: str, image: str = "image_id") -> None:
    """Painted lines under their overlay name."""
    write_dataset(lines.withColumn(image, names.overlay_name(F.col(image))), path)


def write_contact_sheet(document: DataFrame, path: str, directory: str) -> None:
    """Sheet documents as HTML text per directory; :func:`read_lines` reads them."""
    _write_run(document, document, path, directory, "line_no", "html")


def log_metrics(metrics: DataFrame, path: str) -> None:
    """Append ``tag``, ``step``, ``value`` rows."""
    metrics.write.mode("append").parquet(path)


def epoch_path(folder: str, epoch: int, name: str) -> str:
    return f"{folder.rstrip('/')}/epoch_{epoch:03d}_{name}"


def save_model(model: Model, folder: str, epoch: int, *, every: int = 1, name: str = "model") -> str | None:
    """Save at every ``every``-th epoch after the first; returns the path if saved."""
    if epoch <= 0 or epoch % every:
        return None
    target = epoch_path(folder, epoch, name)
    model.write().overwrite().save(target)
    return target


def load_model(path: str) -> LogisticRegressionModel:
    return LogisticRegressionModel.load(path)


def stage_manifest(files: DataFrame, path: str, dst: str) -> DataFrame:
    """Where each ``<num>/sentence/<name>.<ext>`` file goes: ``<dst>/<num>_<name>/<name>.<ext>``."""
    parts = F.split(path, "/")
    file_name = F.element_at(parts, -1)
    num = F.get(F.slice(parts, -3, 1), F.lit(0))
    stem = names.split_ext(file_name)["stem"]
    wanted = files.where(F.get(F.slice(parts, -2, 1), F.lit(0)) == "sentence")
    return wanted.withColumn("target", F.concat(F.lit(f"{dst}/"), num, F.lit("_"), stem, F.lit("/"), file_name))


def write_manifest(manifest: DataFrame, path: str) -> None:
    """Refuses to run when the destination holds anything already."""
    manifest.write.mode("errorifexists").parquet(path)
