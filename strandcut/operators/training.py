"""Gradient descent by epochs: partial sums in every task, one short list of numbers to the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandcut.functions.vectors import doubles
from strandcut.operators.metrics import SLICE_WEIGHTS, rates

EPOCHS, RATE = 21, 0.1
COUNTS = ("tp", "fp", "fn", "tn")
#: What is summed besides the gradient: of the train rows the weights and the weighted loss, of the test rows these and the counts.
SUMS = ("weight", "loss", "eval_weight", "eval_loss", *COUNTS)
STEP = T.StructType([
    T.StructField("epoch", T.LongType()), T.StructField("rate", T.DoubleType()), T.StructField("loss", T.DoubleType()),
    T.StructField("eval_loss", T.DoubleType()), *[T.StructField(c, T.LongType()) for c in COUNTS],
    T.StructField("weights", T.ArrayType(T.DoubleType())),
])


def epoch_sums(df: DataFrame, vec: str, label: str, is_test: str, weights: list[float], class_weights: tuple[float, float]) -> list[float]:
    """``SUMS``, then the gradient's sums, of a logistic model's weights (its bias is the last one).

    Every task adds up its rows; the sums of the tasks are added up by place, so
    the driver is sent as many numbers as there are weights, whatever the rows.
    """
    at = np.array(weights)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(SUMS) + len(at))
        for batch in batches:
            if batch.empty:
                continue
            x = np.column_stack([np.stack(batch["x"].to_list()), np.ones(len(batch))])
            y, test = batch["y"].to_numpy() == 1, batch["test"].to_numpy(bool)
            z = x @ at
            c = np.where(y, class_weights[1], class_weights[0])
            # Of log(1 + exp(-z)) and log(1 + exp(z)), whichever the label asks for.
            loss, said = c * np.logaddexp(0, np.where(y, -z, z)), z > 0
            p = np.where(z >= 0, 1 / (1 + np.exp(-abs(z))), np.exp(-abs(z)) / (1 + np.exp(-abs(z))))
            train = ~test
            total += np.concatenate([
                [c[train].sum(), loss[train].sum(), c[test].sum(), loss[test].sum()],
                [(test & said & y).sum(), (test & said & ~y).sum(), (test & ~said & y).sum(), (test & ~said & ~y).sum()],
                (c * (p - y))[train] @ x[train],
            ])
        yield pd.DataFrame({"place": np.arange(len(total)), "value": total})

    rows = df.select(doubles(F.col(vec)).alias("x"), F.col(label).cast("int").alias("y"), F.col(is_test).alias("test"))
    parts = rows.mapInPandas(add, "place int, value double")
    found = dict(parts.groupBy("place").agg(F.sum("value")).collect())
    return [found.get(i, 0.0) for i in range(len(SUMS) + len(at))]


def train_epochs(
    df: DataFrame, vec: str, label: str, is_test: str, *, width: int, epochs: int = EPOCHS,
    rate: Callable[[Column], Column] = lambda epoch: F.lit(RATE), class_weights: tuple[float, float] = SLICE_WEIGHTS,
    store: str | None = None,
) -> DataFrame:
    """Train a class-weighted logistic model on arrays of ``width`` numbers; one row per epoch.

    Epoch 0 is the model of zeros; epoch t + 1 is a step against the gradient of
    the weighted mean loss over all rows that are no test rows, of size
    ``rate(t)`` (an expression such as ``schedule.cosine_decay``). A row holds the
    loss on both parts and the test rows' confusion under that epoch's weights, and
    the weights. One scan of ``df`` an epoch gives both.

    With ``store``, each epoch is written to that folder as it ends, and a run that finds epochs there goes on from the
    last of them. Rows whose features, label or part are null are left out.
    """
    spark = df.sparkSession
    whole = df.where(F.col(vec).isNotNull() & F.col(label).isNotNull() & F.col(is_test).isNotNull())
    steps = dict(spark.range(epochs + 1).select("id", rate(F.col("id")).cast("double")).collect())
    done = stored_epochs(spark, store) if store else []
    weights = [0.0] * (width + 1)
    out = [tuple(r) for r in done]
    if done:
        weights = _next(whole, vec, label, is_test, done[-1], class_weights) if len(done) <= epochs else weights
    for epoch in range(len(done), epochs + 1):
        sums = epoch_sums(whole, vec, label, is_test, weights, class_weights)
        row = (epoch, steps[epoch], *_means(sums), *[int(s) for s in sums[4:len(SUMS)]], weights)
        out.append(row)
        if store:
            spark.createDataFrame([row], STEP).coalesce(1).write.mode("append").parquet(store)
        weights = _stepped(weights, steps[epoch], sums)
    table = spark.createDataFrame(out, STEP)
    return rates(table).select("epoch", "rate", "loss", "eval_loss", *COUNTS, "accuracy", "recall", "precision", "weights")


def _means(sums: list[float]) -> tuple[float | None, float | None]:
    return tuple(sums[i + 1] / sums[i] if sums[i] else None for i in (0, 2))


def _stepped(weights: list[float], rate: float, sums: list[float]) -> list[float]:
    return [float(w - rate * g / (sums[0] or 1.0)) for w, g in zip(weights, sums[len(SUMS):])]


def _next(df: DataFrame, vec: str, label: str, is_test: str, last, class_weights: tuple[float, float]) -> list[float]:
    sums = epoch_sums(df, vec, label, is_test, last["weights"], class_weights)
    return _stepped(last["weights"], last["rate"], sums)


def stored_epochs(spark: SparkSession, store: str) -> list:
    """The epochs that have been written without a gap, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return []
    rows = {r["epoch"]: r for r in spark.read.schema(STEP).parquet(store).collect()}
    return [rows[i] for i in range(len(rows)) if all(j in rows for j in range(i + 1))]
