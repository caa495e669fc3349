"""Near duplicates among vectors against all pairs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandcut.llm import near_vectors
from strandcut.llm.queries import QUERIES

VECTORS = "vec_id long, embedding array<double>"


def brute(vectors, least=0.9):
    """Links and components of all pairs: ``id -> (links, component)``."""
    ids = list(vectors)
    scaled = [np.asarray(vectors[i], float) / np.max(np.abs(vectors[i])) for i in ids]
    u = np.array([v / np.linalg.norm(v) for v in scaled])
    linked = u @ u.T >= least
    np.fill_diagonal(linked, False)
    comp = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in zip(*np.nonzero(linked)):
            low = min(comp[ids[a]], comp[ids[b]])
            if comp[ids[a]] != low or comp[ids[b]] != low:
                comp[ids[a]] = comp[ids[b]] = low
                changed = True
    return {i: (int(n), comp[i]) for i, n in zip(ids, linked.sum(1))}


def groups(rng, sizes, dim=64, noise=0.03):
    out = []
    for size in sizes:
        centre = rng.normal(size=dim) / np.sqrt(dim)
        out += [centre + rng.normal(size=dim) * noise for _ in range(size)]
    return out


def found(df):
    rows = df.collect()
    assert df.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert all(r.kept == (r.vec_id == r.component_id) for r in rows)
    return {r.vec_id: (r.n_links, r.component_id) for r in rows}


def check(spark, vectors, monkeypatch=None):
    table = dict(enumerate(vectors))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in table.items()], VECTORS).repartition(6)
    assert found(near_vectors.near_vectors(df)) == brute(table)


def test_planted_groups_by_all_pairs(spark):
    rng = np.random.default_rng(3)
    vectors = [*rng.normal(size=(300, 64)), *groups(rng, [2, 3, 5, 60], noise=0.02)]
    vectors += [vectors[0]] * 40 + [vectors[0] * 2.5, vectors[300] * 1e-200, vectors[301] * 1e200]
    check(spark, vectors)


@pytest.mark.parametrize("noise", [0.01, 0.03, 0.055])
def test_groups_beyond_one_block(spark, monkeypatch, noise):
    """Dense groups are linked by angles alone, wide ones partly, block by block."""
    monkeypatch.setattr(near_vectors, "GROUP", 16)
    rng = np.random.default_rng(4)
    check(spark, [*rng.normal(size=(40, 64)), *groups(rng, [150, 40], noise=noise)])


def test_pairs_near_the_threshold(spark):
    """Nearly all pairs just above it are found, and none below."""
    rng = np.random.default_rng(5)
    vectors, want = [], 0
    for i in range(400):
        a = rng.normal(size=64)
        b = rng.normal(size=64)
        a /= np.linalg.norm(a)
        b -= a * (a @ b)
        b /= np.linalg.norm(b)
        cos = 0.9 + (1e-9 if i % 2 else -1e-9)
        vectors += [a, cos * a + np.sqrt(1 - cos * cos) * b]
        want += i % 2
    table = dict(enumerate(vectors))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in table.items()], VECTORS)
    got = found(near_vectors.near_vectors(df))
    truth = brute(table)
    assert all(got[i] in (truth[i], (0, i)) for i in got)
    assert sum(n for n, _ in got.values()) >= 0.9 * 2 * want


@pytest.mark.parametrize("dim", [1, 2, 3, 100])
def test_other_widths(spark, dim):
    rng = np.random.default_rng(dim)
    check(spark, [*rng.normal(size=(60, dim)), *groups(rng, [4, 9], dim, 0.3 / np.sqrt(dim) / 4)])


def test_nulls_zeros_and_repeats(spark):
    rows = [
        (1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [2.0, 0.0]), (None, [0.0, 5.0]), (2, None), (3, [None, 1.0]), (4, [0.0, 0.0]),
        (5, [float("nan"), 1.0]), (6, [3.0]), (7, []), (8, [float("inf"), 0.0]), (9, [-0.0, -1.0]), (10, [0.0, -1.0]), (None, None),
    ]
    df = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit(1) for c in ("cid", "u", "comp", "node", "least", "key", "more")})
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in near_vectors.near_vectors(df).collect())
    assert got == sorted([
        ("1", 3, "1", True), ("1", 3, "1", True), ("None", 3, "1", False), ("None", 0, "None", True), ("2", 0, "2", True),
        ("3", 0, "3", True), ("4", 0, "4", True), ("5", 0, "5", True), ("6", 3, "1", False), ("7", 0, "7", True),
        ("8", 0, "8", True), ("9", 1, "9", True), ("10", 1, "9", False), ("None", 0, "None", True),
    ])
    assert near_vectors.near_vectors(df.limit(0)).collect() == []


def test_estimates_are_unbiased_and_bounds_hold():
    rng = np.random.default_rng(6)
    u = near_vectors.unit(np.vstack([rng.normal(size=(300, 64)), groups(rng, [300], noise=0.08)]))
    rotated = u @ near_vectors.rotation(64, 0)
    codes = near_vectors.Codes(near_vectors.Codes.made(rotated), 64)
    estimate = codes.signs @ codes.rotated.T / (codes.factor[:, None] * 8)
    true = u @ u.T
    off = (estimate - true)[~np.eye(600, dtype=bool)]
    assert abs(off.mean()) < 0.01 and off.std() < 0.12
    open_ = codes.maybe(slice(None), slice(None), 0.9)
    assert (open_ | (true < 0.9)).mean() > 0.9999 and open_[:300, 300:].mean() < 0.02
    assert (codes.close(slice(None), 0.9) | (true < 0.9)).mean() > 0.9999


def test_query_on_the_whole_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    want = brute({r.vec_id: r.embedding for r in rows})
    assert found(QUERIES["op12_embedding_near_dedup"](spark, sf_dir)) == want
