"""Batch scoring with a pluggable model, and the classifier job."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandcut.functions.vectors import argmax_label, doubles
from strandcut.operators.metrics import SLICE_WEIGHTS

BATCH_SIZE = 256


def score_slices(
    df: DataFrame,
    inputs: Sequence[str],
    shapes: Sequence[int],
    make_predict_fn: Callable[[], Callable[..., np.ndarray]],
    out: str = "scores",
    *,
    batch_size: int = BATCH_SIZE,
) -> DataFrame:
    """Add ``out``: the model's output array for each row.

    ``make_predict_fn`` runs once per Python worker and returns a function from
    one 2-D array per input column to a 2-D array, row by row independent.
    """
    score = predict_batch_udf(
        make_predict_fn,
        return_type=T.ArrayType(T.DoubleType()),
        batch_size=batch_size,
        input_tensor_shapes=[[n] for n in shapes],
    )
    return df.withColumn(out, score(*[doubles(F.col(c)) for c in inputs]))


def score_pixels(
    slices: DataFrame,
    make_predict_fn: Callable[[], Callable[[np.ndarray], np.ndarray]],
    out: str = "scores",
    *,
    mean: float = 0.0,
    std: float = 1.0,
    batch_size: int = BATCH_SIZE,
) -> DataFrame:
    """Add ``out`` for slices of one size, read straight from their bytes.

    Pixels are made floats and normalised inside the batch, so that a slice
    crosses into Python once and as bytes.
    """

    @F.pandas_udf("array<double>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        predict = make_predict_fn()
        for px in batches:
            scored: list[np.ndarray] = []
            for at in range(0, len(px), batch_size):
                part = px.iloc[at:at + batch_size]
                x = np.frombuffer(b"".join(part), dtype=np.uint8).reshape(len(part), -1).astype(np.float32)
                scored.extend(np.asarray(predict((x - mean) / std), dtype=np.float64))
            yield pd.Series(scored, index=px.index, dtype=object)

    return slices.withColumn(out, score("px"))


def linear_model(weight: np.ndarray, bias: np.ndarray) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """One linear layer; ``weight`` is (outputs, inputs)."""

    def make() -> Callable[[np.ndarray], np.ndarray]:
        return lambda x: x @ weight.T + bias

    return make


def mlp_head(layers: Sequence[tuple[np.ndarray, np.ndarray]]) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """Linear layers with a rectifier between them."""

    def make() -> Callable[[np.ndarray], np.ndarray]:
        def predict(x: np.ndarray) -> np.ndarray:
            for i, (weight, bias) in enumerate(layers):
                x = x @ weight.T + bias
                if i < len(layers) - 1:
                    x = np.maximum(x, 0.0)
            return x

        return predict

    return make


def gated_fusion(
    first: tuple[np.ndarray, np.ndarray], second: tuple[np.ndarray, np.ndarray]
) -> Callable[[], Callable[[np.ndarray, np.ndarray], np.ndarray]]:
    """Mix two encodings by two gates computed from both of them."""

    def make() -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        def predict(k: np.ndarray, q: np.ndarray) -> np.ndarray:
            hidden = np.concatenate([k, q], axis=1) @ first[0].T + first[1]
            gate = 1.0 / (1.0 + np.exp(-(hidden @ second[0].T + second[1])))
            return gate[:, :1] * k + gate[:, 1:] * q

        return predict

    return make


def label_slices(df: DataFrame, scores: str = "scores", out: str = "label") -> DataFrame:
    """Class with the highest score; the first one on ties."""
    return df.withColumn(out, argmax_label(F.col(scores)))


def train_slice_classifier(
    train: DataFrame,
    features: str,
    label: str,
    weights: tuple[float, float] = SLICE_WEIGHTS,
    *,
    max_iter: int = 21,
    reg: float = 0.0,
):
    """Fit a class-weighted binary classifier on array features."""
    weighted = train.select(
        array_to_vector(doubles(F.col(features))).alias("features"),
        F.col(label).cast("double").alias("label"),
        F.when(F.col(label) == 1, F.lit(weights[1])).otherwise(F.lit(weights[0])).alias("weight"),
    )
    return LogisticRegression(weightCol="weight", maxIter=max_iter, regParam=reg).fit(weighted)


def classify(model, df: DataFrame, features: str) -> DataFrame:
    """Add the model's two scores and the predicted label."""
    ready = df.withColumn("features", array_to_vector(doubles(F.col(features))))
    scored = model.transform(ready)
    return scored.withColumns(
        {"scores": vector_to_array("rawPrediction"), "predicted": F.col("prediction").cast("int")}
    ).drop("features", "rawPrediction", "probability", "prediction")
