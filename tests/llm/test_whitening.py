"""Whitening against exact fractions, numpy's eigenvectors and odd rows."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandcut.llm import whitening
from strandcut.llm.queries import QUERIES

VECTORS = "vec_id long, embedding array<double>"


def whole(v):
    return [math.floor(64 * c) + 1_000_000 for c in v]


def brute(vectors, k=16):
    """Covariance in fractions, axes by numpy: n, sums, deviations, values, axes."""
    xs = [whole(v) for v in vectors]
    fit = sorted(set(map(tuple, xs)))
    n, d = len(fit), len(fit[0])
    sums = [sum(c) for c in zip(*fit)]
    apart = [[n * a - s for a, s in zip(x, sums)] for x in fit]
    v = np.array([[float(Fraction(sum(r[i] * r[j] for r in apart), n ** 3)) for j in range(d)] for i in range(d)])
    values, axes = np.linalg.eigh(v)
    order = np.argsort(-values)[:k]
    deviations = [sum((n * a - s) ** 2 for a, s in zip(x, sums)) for x in xs]
    return n, sums, deviations, values[order], axes[:, order], np.array([[(n * a - s) / n for a, s in zip(x, sums)] for x in xs]), v


def test_axes_are_those_of_the_covariance():
    rng = np.random.default_rng(0)
    for d, rank in ((1, 1), (2, 2), (7, 7), (33, 33), (12, 5)):
        a = rng.normal(size=(d, rank)) * 10.0 ** rng.integers(-1, 3, rank)
        v = a @ a.T
        values, axes = whitening.principal_axes(v)
        want = np.sort(np.linalg.eigvalsh(v))[::-1][:len(values)]
        assert len(values) == rank and np.allclose(values, want, rtol=1e-9, atol=1e-12 * want[0])
        assert np.allclose(axes.T @ axes, np.eye(rank), atol=1e-12)
        assert np.allclose(v @ axes, axes * values, atol=1e-12 * want[0])
    assert len(whitening.principal_axes(np.zeros((3, 3)))[0]) == 0
    order, low = whitening.pivoted_cholesky(np.array([[4.0, 2, 0], [2, 9, 3], [0, 3, 25]]))
    assert order[0] == 2 and np.allclose(np.triu(low, 1), 0)
    assert np.allclose(low @ low.T, np.array([[4.0, 2, 0], [2, 9, 3], [0, 3, 25]])[np.ix_(order, order)])


def check(rows, vectors, k):
    n, sums, deviations, values, axes, centred, v = brute(vectors)
    k = min(k, len(values))
    got = {r.vec_id: r for r in rows}
    w = np.array([got[i].whitened for i in range(len(vectors))])
    assert w.shape[1] == k and all(r.n == n for r in rows)
    assert [got[i].deviation for i in range(len(vectors))] == deviations
    assert np.allclose(rows[0].explained, values[:k] / v.trace(), rtol=1e-9)
    want = centred @ axes[:, :k] / np.sqrt(values[:k])
    signs = np.sign((w * want).sum(0))
    assert np.allclose(w, want * signs, atol=1e-7)
    assert rows[0].identity_error < 1e-9


def test_whitening_by_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(300, 20)) * np.linspace(0.5, 3, 20) + np.linspace(-40, 40, 20)
    vectors[100:220] = vectors[7]  # A third of all rows are copies; they count once.
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], VECTORS).repartition(7)
    check(whitening.whiten(df).collect(), vectors.tolist(), 16)
    check(whitening.whiten(df, 3).collect(), vectors.tolist(), 3)


def test_large_entries_stay_exact(spark):
    vectors = [[1e5 * a, -2e5 * b] for a in range(5) for b in range(4)]
    df = spark.createDataFrame(list(enumerate(vectors)), VECTORS)
    check(whitening.whiten(df).collect(), vectors, 2)
    # Products of such entries pass 2 ** 53, and their sums 2 ** 63.
    huge = [[2.0 ** 36 * a, 2.0 ** 36 * b] for a in range(3) for b in range(2)]
    made = whitening.fit(whitening.whole_vectors(spark.createDataFrame(list(enumerate(huge)), VECTORS), "vec_id", "embedding"))
    assert np.allclose(np.sort(made.values), np.sort(np.linalg.eigvalsh(brute(huge)[-1])), rtol=1e-12)
    with pytest.raises(Exception):
        whitening.whiten(spark.createDataFrame(list(enumerate(huge)), VECTORS)).collect()


def test_nulls_repeats_and_names(spark):
    rows = [
        (1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [0.5, -1.0]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]),
        (5, [float("inf"), 1.0]), (6, [3.0]), (7, [3.0, 0.0]), (8, []),
    ]
    df = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit("a") for c in ("x", "n", "deviation", "at", "whitened")})
    got = whitening.whiten(df).collect()
    assert sorted(str(r.vec_id) for r in got) == ["1", "1", "6", "7", "8", "None"]
    assert {r.n for r in got} == {4} and all(len(r.whitened) == 2 for r in got)
    by = {r.vec_id: r for r in got}
    assert by[6].whitened == by[7].whitened
    n, sums, deviations, *_ = brute([[1, 2], [0.5, -1], [3, 0], [0, 0]])
    assert [by[1].deviation, by[None].deviation, by[6].deviation, by[8].deviation] == deviations


def test_few_and_no_vectors(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], VECTORS)
    assert whitening.whiten(one).count() == 0 and whitening.whiten(one.limit(0)).count() == 0
    two = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 4.0])], VECTORS)
    got = whitening.whiten(two).collect()
    assert sorted(abs(r.whitened[0]) for r in got) == pytest.approx([1, 1]) and len(got[0].whitened) == 1


def test_query_on_the_whole_table(spark, sf_dir):
    got = QUERIES["op11_embedding_whitening"](spark, sf_dir)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = got.toPandas()
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    assert len(rows) == 16 * len(table) and rows["identity_error"].iloc[0] < 1e-9
    n, _, deviations, values, _, _, v = brute([x.astype(float).tolist() for x in table["embedding"]])
    assert (rows["n"] == n).all()
    assert dict(zip(rows["vec_id"], rows["deviation"])) == dict(zip(table["vec_id"], deviations))
    assert np.allclose(rows.groupby("component")["explained"].first(), values / v.trace(), rtol=1e-9)
