"""Operator 11: whitening of embeddings: pivoted Cholesky of the centred scatter, one-sided Jacobi on its factor."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandcut.llm.common import stored
from strandcut.llm.registry import query, table
from strandcut.llm.vectors import usable

COMPONENTS, SCALE, SHIFT = 16, 64, 1_000_000
#: Rounds of rotations over all pairs of columns; a dozen are enough for any matrix of a few thousand.
SWEEPS = 60
#: Sums of whole numbers stay below this in 64 bits; products of two numbers below the other are exact in doubles.
SAFE, EXACT = 2 ** 62, 2 ** 26


def whole_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, x`` of all rows whose vector is whole and finite: ``x = floor(64 c) + 1000000``, filled up to one length."""
    rows = df.where(usable(F.col(vector_col))).select(
        F.col(id_col).alias("vec_id"),
        F.transform(vector_col, lambda c: F.floor(c.cast("double") * SCALE).cast("bigint") + SHIFT).alias("x"),
    )
    rows = stored(rows, "whitening-vectors")
    least, most = rows.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if least == most:
        return rows
    return rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(SHIFT).cast("bigint"), F.lit(most) - F.size("x"))))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _added(df: DataFrame, width: int, parts: Callable[[Iterator[np.ndarray]], list]) -> list:
    """Lists of numbers made in every task, added up by place: one row a place and task is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = parts(_matrix(b.column(0), width) for b in batches if b.num_rows)
        for at, numbers in enumerate(made):
            yield pa.RecordBatch.from_arrays(
                [pa.array([at], pa.int32()), pa.array([pickle.dumps(numbers)], pa.binary())], names=["at", "numbers"]
            )

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = 0
        for numbers in rows["numbers"]:
            total = total + pickle.loads(numbers)
        return pd.DataFrame({"at": [rows["at"].iloc[0]], "numbers": [pickle.dumps(total)]})

    schema = "at int, numbers binary"
    found = df.select("x").mapInArrow(run, schema).groupBy("at").applyInPandas(add, schema).collect()
    return [pickle.loads(r["numbers"]) for r in sorted(found, key=lambda r: r["at"])]


def _sums(batches: Iterator[np.ndarray]) -> list:
    total = 0
    for x in batches:
        safe = int(abs(x).max()) * len(x) < SAFE
        total = total + (x if safe else x.astype(object)).sum(0).astype(object)
    return [] if isinstance(total, int) else [total]


def _products(centre: np.ndarray) -> Callable[[Iterator[np.ndarray]], list]:
    """Exact sums of the products of centred components, row by row."""

    def parts(batches: Iterator[np.ndarray]) -> list:
        total: np.ndarray | int = 0
        part, held = 0, 0
        for x in batches:
            y = x - centre
            most = max(1, int(abs(y).max()))
            if most >= EXACT:
                y = y.astype(object)
                total = total + y.T @ y
                continue
            step = max(1, 2 ** 53 // most ** 2)
            for at in range(0, len(y), step):
                block = y[at:at + step].astype(np.float64)
                size = most ** 2 * len(block)
                if held + size > SAFE:
                    total, part, held = total + part.astype(object), 0, 0
                part, held = part + (block.T @ block).astype(np.int64), held + size
        if held:
            total = total + part.astype(object)
        return [] if isinstance(total, int) else list(total)

    return parts


def pivoted_cholesky(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``order`` and the lower factor: ``v[order][:, order] = low @ low.T``, as many columns as the rank."""
    d = len(v)
    order, low, left = np.arange(d), np.zeros((d, d)), v.diagonal().copy()
    least = d * np.finfo(float).eps * left.max(initial=0)
    for k in range(d):
        p = k + int(left[k:].argmax())
        if left[p] <= least:
            return order, low[:, :k]
        order[[k, p]], left[[k, p]], low[[k, p]] = order[[p, k]], left[[p, k]], low[[p, k]]
        low[k, k] = np.sqrt(left[k])
        low[k + 1:, k] = (v[order[k + 1:], order[k]] - low[k + 1:, :k] @ low[k, :k]) / low[k, k]
        left[k + 1:] -= low[k + 1:, k] ** 2
    return order, low


def one_sided_jacobi(low: np.ndarray) -> np.ndarray:
    """``low`` times rotations that make its columns orthogonal; disjoint pairs are rotated together."""
    g, k = low.copy(), low.shape[1]
    ring = list(range(k)) + [-1] * (k % 2)
    half = len(ring) // 2
    for _ in range(SWEEPS):
        turned = 0
        for _ in range(max(0, len(ring) - 1)):
            pairs = [(a, b) for a, b in zip(ring[:half], reversed(ring[half:])) if min(a, b) >= 0]
            ring = [ring[0], ring[-1], *ring[1:-1]]
            if not pairs:
                continue
            p, q = np.array(pairs).T
            x, y = g[:, p], g[:, q]
            a, b, c = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            do = abs(c) > np.finfo(float).eps * np.sqrt(a * b)
            if not do.any():
                continue
            turned += int(do.sum())
            p, q, x, y, a, b, c = p[do], q[do], x[:, do], y[:, do], a[do], b[do], c[do]
            z = (b - a) / (2 * c)
            t = np.where(z >= 0, 1.0, -1.0) / (abs(z) + np.hypot(1.0, z))
            cos = 1 / np.hypot(1.0, t)
            g[:, p], g[:, q] = cos * x - cos * t * y, cos * t * x + cos * y
        if not turned:
            break
    return g


def principal_axes(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a covariance, falling, and unit eigenvectors as columns; those of value 0 are left out."""
    order, low = pivoted_cholesky(v)
    g = one_sided_jacobi(low)
    norms = np.sqrt((g * g).sum(0))
    falling = np.argsort(-norms, kind="stable")
    axes = np.zeros_like(g)
    axes[order] = g[:, falling] / norms[falling]
    return norms[falling] ** 2, axes


@dataclass
class Whitening:
    """What a fit gives: sums and count of the fit list, its first axes and the eigenvalues."""

    n: int
    sums: list[int]
    axes: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def centre(self) -> np.ndarray:
        """The mean, rounded to whole numbers."""
        return np.array([round(s / self.n) for s in self.sums], np.int64)

    def apart(self, x: np.ndarray) -> np.ndarray:
        """``n x - sums``, exact."""
        centre = self.centre
        rest = [s - self.n * int(c) for s, c in zip(self.sums, centre)]
        y = x - centre
        if int(abs(y).max(initial=0)) * self.n < SAFE:
            return y * self.n - np.array(rest, np.int64)
        return y.astype(object) * self.n - np.array(rest, object)

    def project(self, apart: np.ndarray) -> np.ndarray:
        return (apart / self.n).astype(np.float64) @ self.axes / np.sqrt(self.values)


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Axes of the distinct vectors ``x``; None without any.

    The scatter is added up in whole numbers around the rounded mean and the
    rest of the mean taken off exactly, so the covariance is right to the last bit
    whatever the order of the tasks. A task sends one row for each dimension; the
    driver holds one matrix of the dimensions.
    """
    distinct = stored(vectors.select("x").distinct(), "whitening-fit")
    n = distinct.count()
    width = (distinct.agg(F.max(F.size("x"))).first()[0] or 0) if n else 0
    if not width:
        return None
    sums = [int(s) for s in _added(distinct, width, _sums)[0]]
    found = Whitening(n, sums, np.zeros((width, 0)), np.zeros(0), 0.0)
    rows = _added(distinct, width, _products(found.centre))
    rest = [s - n * int(c) for s, c in zip(sums, found.centre)]
    v = np.array([
        [(n * int(rows[i][j]) - rest[i] * rest[j]) / (n * n) for j in range(width)] for i in range(width)
    ])
    values, axes = principal_axes(v)
    found.values, found.axes, found.trace = values[:components], axes[:, :components], float(v.trace())
    if len(found.values):
        found.identity_error = _identity_error(distinct, width, found)
    return found


def _identity_error(distinct: DataFrame, width: int, made: Whitening) -> float:
    def parts(batches: Iterator[np.ndarray]) -> list:
        total: np.ndarray | int = 0
        for x in batches:
            w = made.project(made.apart(x))
            total = total + np.vstack([w.sum(0), w.T @ w])
        return [] if isinstance(total, int) else [total]

    total = _added(distinct, width, parts)[0]
    mean = total[0] / made.n
    covariance = total[1:] / made.n - np.outer(mean, mean)
    return float(abs(covariance - np.eye(len(mean))).max())


def whiten(
    embeddings: DataFrame, components: int = COMPONENTS, *, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """``vec_id, n, deviation, whitened, explained, identity_error`` of every vector, the last but one as arrays.

    Rows whose vector is null or holds a null or a non-finite entry are left
    out. Entries become whole numbers ``x``; shorter vectors are filled up as
    with entries 0. The axes are those of the covariance of the distinct ``x``
    vectors. ``whitened`` holds the centred vector's projections on the first
    ``components`` axes, each divided by the root of its eigenvalue; ``deviation``
    the exact sum of squares of ``n x - sums``, an error where it does not fit 64 bits.

    Repeated rows stay, and so do rows without an id. Axes of eigenvalue 0 do
    not exist, so fewer distinct vectors than components give shorter arrays;
    with one distinct vector, or none, there are no rows. Other columns are left out.
    """
    rows = whole_vectors(embeddings, id_col, vector_col)
    made = fit(rows, components)
    kind = T.StructType([
        T.StructField("vec_id", rows.schema["vec_id"].dataType), T.StructField("deviation", T.LongType()),
        T.StructField("whitened", T.ArrayType(T.DoubleType())),
    ])
    if made is None or not len(made.values):
        rows, made = rows.limit(0), Whitening(0, [], np.zeros((0, 0)), np.zeros(0), 1.0)
    width, k = len(made.sums), len(made.values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            apart = made.apart(_matrix(batch.column(1), width))
            if float(abs(apart).max(initial=0)) ** 2 * width < SAFE:
                deviation = (apart * apart).sum(1)
            else:
                deviation = (apart.astype(object) ** 2).sum(1)
            w = made.project(apart)
            ends = pa.array(np.arange(0, w.size + 1, k, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(deviation.tolist(), pa.int64()), pa.ListArray.from_arrays(ends, pa.array(w.ravel()))],
                names=["vec_id", "deviation", "whitened"],
            )

    explained = F.array(*[F.lit(float(e) / made.trace) for e in made.values]).cast("array<double>")
    return rows.select("vec_id", "x").mapInArrow(project, kind).select(
        "vec_id", F.lit(made.n).cast("bigint").alias("n"), "deviation", "whitened",
        explained.alias("explained"), F.lit(made.identity_error).alias("identity_error"),
    )


@query("op11_embedding_whitening")
def embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whiten(table(spark, sf_dir, "embeddings"))
    each = rows.select("*", F.posexplode("whitened").alias("at", "value"))
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("value").alias("whitened"),
        F.get("explained", F.col("at")).alias("explained"), "identity_error",
    )
