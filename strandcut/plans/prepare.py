"""Label files to training sets, and the evaluation of a fitted classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandcut.functions import names, notation
from strandcut.operators import labelling, metrics, sampling, scoring, sequences
from strandcut.operators.ordering import ordered_index
from strandcut.schemas import METRICS

#: Rows of a batch of the evaluation.
BATCH = 256


def numbered_files(files: DataFrame) -> DataFrame:
    """Slice files with the number in their name."""
    named = names.parse_number_pair(names.base_name(F.col("path")))
    return files.select("dir", named["idx"].alias("idx"), "path")


def label_problems(files: DataFrame, label_lines: DataFrame) -> DataFrame:
    """Everything that would make the labels unusable: ``dir``, ``problem``, ``detail``.

    Misplaced or unreadable file names, directories without label rows,
    malformed rows, and rows beyond the last slice.
    """
    specs = labelling.clean_label_lines(label_lines, "raw")
    counts = files.groupBy("dir").agg(F.count(F.lit(1)).alias("n"))
    good = specs.where(notation.well_formed(F.col("spec")))
    found = [
        labelling.file_index_violations(files, "dir", "path").select("dir", F.lit("file_index").alias("problem"), F.col("path").alias("detail")),
        labelling.missing_labels(counts, label_lines.select("dir").distinct(), "dir").select(
            "dir", F.lit("no_label_file").alias("problem"), F.lit(None).cast("string").alias("detail")
        ),
        labelling.label_errors(specs, "spec").select("dir", F.col("error").alias("problem"), F.col("spec").alias("detail")),
        labelling.specs_out_of_range(good, counts, "dir", "spec", "n").select(
            "dir", F.lit("out_of_range").alias("problem"), F.col("spec").alias("detail")
        ),
    ]
    return labelling.collect_all(found)


def labelled_slices(files: DataFrame, label_lines: DataFrame, *, strict: bool = True) -> DataFrame:
    """Slice files with type and flag from the label rows of their directory.

    With ``strict`` a malformed row fails the job; see :func:`label_problems`
    for the other checks.
    """
    specs = labelling.clean_label_lines(label_lines, "raw")
    expanded = labelling.expand_labels(specs, "spec", strict=strict)
    marked = labelling.last_flags(expanded, ["dir", "idx"])
    return labelling.apply_labels(numbered_files(files), marked, ["dir", "idx"])


def slice_sets(labelled: DataFrame, *, fraction: float, seed: int, times: int = 2) -> DataFrame:
    """Split, then oversample both parts; ``is_test`` tells them apart."""
    split = sampling.train_test_split(labelled, ["dir", "idx"], fraction, seed)
    return sampling.oversample(split, F.col("import_flag"), times)


def sequence_sets(
    labelled: DataFrame, *, fraction: float, seed: int, size: int = 80, step: int = 40
) -> DataFrame:
    """Packed windows over all directories in order, split by window."""
    ordered = ordered_index(labelled, ["dir", "idx"], "seq_no")
    windows = sequences.count_windows(ordered, "seq_no", size=size, step=step)
    packed = sequences.sequence_pack(windows, ["path", "image_type", "import_flag"])
    return sampling.train_test_split(packed, "window_id", fraction, seed)


def evaluate(
    model, test: DataFrame, features: str, label: str, epoch: int, *, order: str, size: int = BATCH, part: str = "eval"
) -> DataFrame:
    """Metric rows of one evaluation of a model: ``tag``, ``step``, ``value``."""
    scored = scoring.classify(model, test, features)
    scored = scored.withColumns({"z0": F.get("scores", F.lit(0)), "z1": F.get("scores", F.lit(1))})
    return evaluation(scored, label, epoch, order=order, size=size, part=part)


def evaluation(
    scored: DataFrame, label: str, epoch: int, *, order: str, size: int = BATCH, part: str = "eval"
) -> DataFrame:
    """Metric rows of rows scored ``z0, z1, predicted``, in batches of ``size`` along ``order``.

    Loss (class-weighted in each batch) and accuracy are means over the batches, of
    which a short last one counts as much as a full one; recall and precision are those of all rows.
    """
    rows = sequences.batch_ids(scored.select(order, label, "z0", "z1", "predicted"), order, size)
    per = metrics.weighted_ce(rows, label, "z0", "z1", by="batch_id").agg(F.avg("loss").alias("loss"))
    accuracy = metrics.accuracy_batch_mean(rows, label, "predicted", "batch_id")
    counts = metrics.rates(metrics.confusion(rows, label, "predicted")).select("recall", "precision")
    # One row each.
    summary = per.join(accuracy, how="cross").join(counts, how="cross").withColumn("epoch", F.lit(epoch).cast("bigint"))
    tags = {"accuracy": "acc", "loss": "loss", "recall": "recall", "precision": "precision"}
    return metrics.metric_long(summary, "epoch", {c: f"{part}/{t}" for c, t in tags.items()})


def training_log(spark: SparkSession, model, first_step: int = 0) -> DataFrame:
    """Loss after each iteration of the fit, as metric rows."""
    losses = model.summary.objectiveHistory
    rows = [("train/loss", first_step + i, float(v)) for i, v in enumerate(losses)]
    return spark.createDataFrame(rows, METRICS)
