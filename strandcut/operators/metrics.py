"""Evaluation of predicted against human labels (class 1 is the positive one)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandcut.operators.ordering import as_list

# Fixed class weights of the two training set-ups.
SLICE_WEIGHTS = (0.3, 0.7)
SEQUENCE_WEIGHTS = (0.25, 0.75)


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def confusion(df: DataFrame, y: str, p: str, by: str | Sequence[str] | None = None) -> DataFrame:
    """Counts ``tp``, ``fp``, ``fn``, ``tn``."""
    hit, said = F.col(y) == 1, F.col(p) == 1
    return df.groupBy(*as_list(by)).agg(
        F.count_if(hit & said).alias("tp"),
        F.count_if(~hit & said).alias("fp"),
        F.count_if(hit & ~said).alias("fn"),
        F.count_if(~hit & ~said).alias("tn"),
    )


def rates(counts: DataFrame) -> DataFrame:
    """Accuracy, precision and recall from confusion counts; 0 where nothing was counted."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.withColumns(
        {
            "accuracy": _ratio(tp + tn, tp + fp + fn + tn),
            "precision": _ratio(tp, tp + fp),
            "recall": _ratio(tp, tp + fn),
        }
    )


def accuracy_rows(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.agg(F.avg((F.col(y) == F.col(p)).cast("double")).alias("accuracy"))


def accuracy_batch_mean(df: DataFrame, y: str, p: str, batch: str) -> DataFrame:
    """Mean of the batch accuracies; a short batch counts as much as a full one."""
    per = df.groupBy(batch).agg(F.avg((F.col(y) == F.col(p)).cast("double")).alias("__acc"))
    return per.agg(F.count(F.lit(1)).alias("batches"), F.avg("__acc").alias("accuracy"))


def recall(df: DataFrame, y: str, p: str) -> DataFrame:
    return rates(confusion(df, y, p)).select("recall")


def precision(df: DataFrame, y: str, p: str) -> DataFrame:
    return rates(confusion(df, y, p)).select("precision")


def cross_entropy(z0: Column, z1: Column, y: Column) -> Column:
    """Loss of one row from its two logits, with the larger one taken out first."""
    top = F.greatest(z0, z1)
    return top + F.log(F.exp(z0 - top) + F.exp(z1 - top)) - F.when(y == 1, z1).otherwise(z0)


def weighted_ce(
    df: DataFrame,
    y: str,
    z0: str,
    z1: str,
    weights: tuple[float, float] = SLICE_WEIGHTS,
    by: str | Sequence[str] | None = None,
) -> DataFrame:
    """Class-weighted mean cross entropy: sum of weight times loss over sum of weights."""
    w = F.when(F.col(y) == 1, F.lit(weights[1])).otherwise(F.lit(weights[0]))
    loss = cross_entropy(F.col(z0), F.col(z1), F.col(y))
    return df.groupBy(*as_list(by)).agg((F.sum(w * loss) / F.sum(w)).alias("loss"))


def loss_batch_mean(
    df: DataFrame, y: str, z0: str, z1: str, batch: str, weights: tuple[float, float] = SLICE_WEIGHTS
) -> DataFrame:
    per = weighted_ce(df, y, z0, z1, weights, by=batch)
    return per.agg(F.count(F.lit(1)).alias("batches"), F.avg("loss").alias("loss"))


def dir_counts(df: DataFrame, directory: str, label: str) -> DataFrame:
    """Slices predicted as separators in every directory; 0 where there are none."""
    return df.groupBy(directory).agg(F.count_if(F.col(label) == 1).alias("n_predicted"))


def metric_long(summary: DataFrame, step: str | Column, tags: Mapping[str, str]) -> DataFrame:
    """One row per scalar: ``tag``, ``step``, ``value``. ``tags`` maps columns to tags."""
    step_col = F.col(step) if isinstance(step, str) else step
    pairs = F.array(
        *[F.struct(F.lit(tag).alias("tag"), F.col(c).cast("double").alias("value")) for c, tag in tags.items()]
    )
    rows = summary.select(step_col.cast("bigint").alias("step"), F.explode(pairs).alias("__m"))
    return rows.select("__m.tag", "step", "__m.value")


def epoch_summary(df: DataFrame, epoch: str, y: str, p: str, loss: str) -> DataFrame:
    """Loss, accuracy, recall and precision per epoch, from scored rows."""
    hit, said = F.col(y) == 1, F.col(p) == 1
    counted = df.groupBy(epoch).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(loss).alias("loss"),
        F.count_if(hit & said).alias("tp"),
        F.count_if(~hit & said).alias("fp"),
        F.count_if(hit & ~said).alias("fn"),
        F.count_if(~hit & ~said).alias("tn"),
    )
    return rates(counted).select(epoch, "n", "loss", "accuracy", "recall", "precision")
