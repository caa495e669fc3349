"""Operator 5: quality by co-training a text view and a metadata view."""

from __future__ import annotations

import math
import warnings
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandcut.llm.arrow import slices
from strandcut.llm.common import dropped, stored
from strandcut.llm.registry import query, table

#: About so many labelled documents are used to fit; views exchange on all others.
TRAIN_ROWS = 6_000
ROUNDS, CONFIDENT = 3, 0.97
WORD_SLOTS, META_SLOTS = 256, 64
SIGNS = "!%#&$*|"
THRESHOLD = 0.5
LETTERS = re.compile(r"[A-Za-z]")
LONG_STATS = 2 * (9 + len(SIGNS))


def _slot(word: str, slots: int) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) % slots


def text_features(text: str | None, slots: dict[str, int]) -> np.ndarray:
    """Statistics of the whole text and the shares of hashed words."""
    text = text or ""
    words = text.split()
    n, size = max(1, len(words)), max(1, len(text))
    lines = text.split("\n")
    upper = sum(map(str.isupper, words)) / n
    stats = [
        upper, len(set(words)) / n, min(1.0, len(words) / 1000), len(text) / n / 20, len(set(lines)) / len(lines),
        sum(map(str.isalpha, words)) / n, sum(map(str.isdigit, words)) / n, float(not words),
        math.log1p(n) / 10, *[min(1.0, 20 * text.count(c) / size) for c in SIGNS],
    ]
    stats = np.array(stats)
    out = np.zeros(LONG_STATS + WORD_SLOTS)
    # Square roots let a small share of junk count.
    out[:LONG_STATS] = np.concatenate([stats, np.sqrt(np.abs(stats))])
    if words:
        found = np.fromiter(map(slots.__getitem__, words), np.int64, len(words))
        out[LONG_STATS:] = np.sqrt(np.bincount(found, minlength=WORD_SLOTS) / n)
    return out


def meta_features(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    out = np.zeros(META_SLOTS + 3)
    out[_slot(f"lang {lang}", META_SLOTS)] = 1
    out[_slot(f"source {source}", META_SLOTS)] = 1
    size = math.log1p(max(0, n_chars or 0)) / 10
    out[-3:] = [size, size * size, n_chars is None]
    return out


class _Slots(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = h = _slot(word, WORD_SLOTS)
        return h


@dataclass
class View:
    """A fitted view: weights, and the slope and offset that calibrate its margin."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def log_odds(self, features: np.ndarray) -> np.ndarray:
        return self.slope * (features @ self.weights + self.bias) + self.offset


@dataclass
class Model:
    text: View
    meta: View
    prior: float

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chance of good quality by both views together, by the text, by the metadata."""
        a, b = self.text.log_odds(text), self.meta.log_odds(meta)
        together = a + b - self.prior
        return tuple(1 / (1 + np.exp(-np.clip(x, -30, 30))) for x in (together, a, b))


def _features(rows: DataFrame) -> DataFrame:
    """``label, fold, text_v, meta_v`` of rows ``text, lang, source, n_chars, label, fold``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = _Slots()
        for batch in batches:
            for part in slices(batch, 0):
                text, lang, source, n_chars, label, fold = (c.to_pylist() for c in part.columns)
                yield pa.RecordBatch.from_arrays([
                    pa.array(label, pa.float64()), pa.array(fold, pa.int32()),
                    pa.array([text_features(t, slots).tolist() for t in text], pa.list_(pa.float32())),
                    pa.array([meta_features(*m).tolist() for m in zip(lang, source, n_chars)], pa.list_(pa.float32())),
                ], names=["label", "fold", "text_v", "meta_v"])

    return rows.select("text", "lang", "source", "n_chars", "label", "fold").mapInArrow(
        run, "label double, fold int, text_v array<float>, meta_v array<float>"
    )


def _fit(rows: DataFrame, view: str) -> View:
    made = LogisticRegression(maxIter=40, regParam=0.002, featuresCol="f", labelCol="y", aggregationDepth=2).fit(
        rows.select(array_to_vector(F.col(view).cast("array<double>")).alias("f"), "y")
    )
    return View(made.coefficients.toArray(), float(made.intercept))


def _margins(rows: DataFrame, view: str, fitted: View) -> DataFrame:
    """Rows with ``p``, the view's calibrated chance of good quality."""
    weights = F.array(*[F.lit(float(w)) for w in fitted.weights])
    dot = F.aggregate(F.zip_with(view, weights, lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x)
    odds = fitted.slope * (dot + fitted.bias) + fitted.offset
    return rows.withColumn("p", 1 / (1 + F.exp(-odds)))


def _calibrated(rows: DataFrame, view: str, fitted: View, shift: float) -> View:
    """Slope and offset of the margin on labelled rows that the view was not fitted to.

    ``shift`` leads from the log odds of those rows to the ones that hold.
    """
    raw = _margins(rows, view, View(fitted.weights, fitted.bias)).withColumn("m", F.array(F.log(F.col("p") / (1 - F.col("p")))))
    raw = raw.withColumn("m", F.transform("m", lambda m: F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.coalesce(m, F.lit(30.0))))))
    line = _fit(raw, "m")
    return View(fitted.weights, fitted.bias, float(line.weights[0]), line.bias + shift)


def _labelled(docs: DataFrame, labels: DataFrame, one_class: bool = False) -> tuple[DataFrame, float] | None:
    """A bounded sample of labelled documents (folds 0 to 3) and all others (fold -1, no label); the log odds of all labels.

    Each class has up to about ``TRAIN_ROWS / 2`` documents, dealt to the folds
    within the class; the only document of a class is in folds 0 and 1. Labels other than 0 and 1 are
    left out with a warning that counts them. None without any label.
    """
    named = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
    other = named.where("quality NOT IN (0, 1)").count()
    if other:
        warnings.warn(f"{other} quality labels other than 0 and 1 are left out", stacklevel=3)
    known = named.where("quality IN (0, 1)").groupBy("doc_id").agg(
        F.min("quality").cast("double").alias("label")
    ).join(docs.select("doc_id"), "doc_id", "left_semi")
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if not counts:
        return None
    if len(counts) == 1:
        if one_class:
            return None
        raise ValueError(f"all labelled documents have quality {next(iter(counts)):g}: there is nothing to tell apart")
    share = lambda wanted, of: F.pmod(F.xxhash64("doc_id", F.lit(wanted)), F.lit(1 << 20)) < math.ceil((1 << 20) * min(1.0, wanted / max(1, of)))
    half = TRAIN_ROWS // 2
    chosen = known.where(F.when(F.col("label") == 1, share(half, counts[1.0])).otherwise(share(half, counts[0.0])))
    # At most about TRAIN_ROWS rows of numbers are ranked, and sent to all tasks.
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id"))
    alone = F.col("label").isin([c for c, n in counts.items() if n == 1])
    chosen = chosen.withColumn("fold", ((rank - 1) % 4).cast("int")).withColumn(
        "fold", F.explode(F.when(alone, F.array(F.lit(0), F.lit(1))).otherwise(F.array("fold")))
    )
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars").join(F.broadcast(chosen), "doc_id", "left")
    return _features(rows.withColumn("fold", F.coalesce("fold", F.lit(-1)))), math.log(counts[1.0] / counts[0.0])


def train(
    docs: DataFrame, labels: DataFrame, *, rounds: int = ROUNDS, confident: float = CONFIDENT, one_class: bool = False
) -> Model | None:
    """Co-train both views; None without labelled documents.

    Labels of one class only are an error, unless ``one_class`` says that no model is to be made of them.

    Each round fits both views to their own training rows, calibrates them on a
    fourth of the labelled rows, and lets each hand its confident verdicts on
    documents without labels to the other. The labelled rows are bounded by
    ``TRAIN_ROWS``, the others are all there are; chances are those at the
    shares that good and bad have among all labels.
    """
    found = _labelled(docs, labels, one_class)
    if found is None:
        return None
    rows, prior = stored(found[0], "quality-features"), found[1]
    sample, pool = stored(rows.where("fold >= 0"), "quality-sample"), rows.where("fold = -1")
    fit, held = sample.where("fold > 0"), sample.where("fold = 0")
    fit, held = fit.withColumn("y", F.col("label")), held.withColumn("y", F.col("label"))
    good, n = held.agg(F.sum("y"), F.count(F.lit(1))).first()
    shift = prior - math.log(good / (n - good))
    extra = {"text_v": None, "meta_v": None}
    views: dict[str, View] = {}
    for turn in range(rounds):
        for view in views or extra:
            mine = fit if extra[view] is None else fit.unionByName(extra[view])
            views[view] = _calibrated(held, view, _fit(mine.select(view, "y"), view), shift)
        if turn + 1 < rounds:
            for view, other in (("text_v", "meta_v"), ("meta_v", "text_v")):
                told = _margins(pool, view, views[view])
                extra[other] = told.where((F.col("p") >= confident) | (F.col("p") <= 1 - confident)).withColumn(
                    "y", (F.col("p") >= 0.5).cast("double")
                ).drop("p")
    dropped(rows, sample)
    return Model(views["text_v"], views["meta_v"], prior)


SCORED = pa.schema([("score", pa.float64()), ("text_score", pa.float64()), ("meta_score", pa.float64())])


def score_documents(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with ``score, text_score, meta_score``: chances of good quality.

    All documents are scored, by their whole texts; null texts count as empty
    and null metadata is a value of its own. Without a model all score 1. Rows
    stay as they are; columns of the three names are replaced.
    """
    kept = [c for c in docs.columns if c not in SCORED.names]
    if model is None:
        return docs.select(*kept).withColumns({c: F.lit(1.0) for c in SCORED.names})
    schema = docs.select(*kept).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = _Slots()
        for batch in batches:
            at = batch.schema.names.index("text")
            for part in slices(batch, at):
                text = np.array([text_features(t, slots) for t in part.column(at).to_pylist()])
                meta = np.array([meta_features(*m) for m in zip(*[
                    part.column(part.schema.names.index(c)).to_pylist() for c in ("lang", "source", "n_chars")
                ])])
                scores = [pa.array(x) for x in model.scores(text, meta)]
                yield pa.RecordBatch.from_arrays([*part.columns, *scores], names=[*part.schema.names, *SCORED.names])

    for name in SCORED.names:
        schema = schema.add(name, "double")
    return docs.select(*kept).mapInArrow(run, schema)


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Every document with its scores and ``keep``: whether quality is at least as likely good as bad."""
    return score_documents(docs, train(docs, labels)).withColumn("keep", F.col("score") >= threshold)


@query("op5_quality_classifier")
def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged = judge(docs, table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "score", "text_score", "meta_score", "keep")
