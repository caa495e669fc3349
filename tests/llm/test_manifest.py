"""The Merkle manifest against a plain computation of its definition."""

from __future__ import annotations

import hashlib
import zlib
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from strandcut.llm import manifest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def said(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(r, more=0):
    n = r["n_chars"] if r["n_chars"] is None else r["n_chars"] + more
    return h(said(r["doc_id"]), said(r["source"]), said(r["lang"]), said(n), said(r["text"]))


def climb(nodes, at, digest):
    """The root, the siblings on the way and what ``digest`` in place ``at`` folds to."""
    beside = []
    while len(nodes) > 1:
        run = nodes[at - at % 2:at - at % 2 + 2]
        beside += run[:at % 2] + run[at % 2 + 1:]
        digest = h(*run[:at % 2], digest, *run[at % 2 + 1:])
        nodes, at = [h(*nodes[i:i + 2]) for i in range(0, len(nodes), 2)], at // 2
    return nodes[0], beside, digest


def brute(rows):
    first = lambda v: (v is not None, v)
    rows = sorted(rows, key=lambda r: (first(None if r["lang"] is None else r["lang"].encode()), first(r["doc_id"]), leaf(r)))
    trees = [list(g) for _, g in groupby(rows, key=lambda r: r["lang"])]
    roots = [climb([leaf(r) for r in g], 0, "")[0] for g in trees]
    out = []
    for t, g in enumerate(trees):
        for i, r in enumerate(g):
            bad = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            subroot, below, folded = climb([leaf(x) for x in g], i, leaf(r, int(bad)))
            root, above, folded = climb(roots, t, folded)
            out.append((r["doc_id"], leaf(r), subroot, root, h(*below, *above), folded, folded == root))
    return sorted(out, key=repr)


def proofs(df):
    more = F.when(F.col("n_chars").isNotNull(), F.col("n_chars").cast("decimal(20,0)") + 1)
    got = manifest.manifest_proofs(
        df, tampered=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, tampered_fields={"n_chars": more}
    )
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, got.collect()), key=repr)


@pytest.mark.parametrize("sizes", [
    {"a": 1}, {"a": 3, "b": 2, None: 1}, {"de": 200, "en": 129, "": 1, "é": 7, "zz": 63},
])
def test_proofs_by_brute_force(spark, sizes):
    rows, n = [], 0
    for lang, size in sizes.items():
        for i in range(size):
            n += 1
            rows.append({"doc_id": n * 37 % 1009, "text": f"text {n}", "lang": lang, "source": "s" if i % 3 else None, "n_chars": n if i % 5 else None})
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    assert proofs(df) == brute(rows)


def test_three_depths_of_records(spark, monkeypatch):
    monkeypatch.setattr(manifest, "LEVELS", 2)
    monkeypatch.setattr(manifest, "WIDTH", 4)
    rows = [{"doc_id": i, "text": str(i), "lang": "en" if i % 10 else f"l{i}", "source": None, "n_chars": i} for i in range(150)]
    assert proofs(spark.createDataFrame(rows, DOCS)) == brute(rows)


def test_nulls_repeats_and_long_texts(spark):
    one = {"doc_id": 1, "text": "same", "lang": "en", "source": "a", "n_chars": 4}
    rows = [one] * 300 + [
        {"doc_id": None, "text": None, "lang": None, "source": None, "n_chars": None},
        {"doc_id": None, "text": "", "lang": "en", "source": "", "n_chars": 0},
        {"doc_id": 1, "text": "other", "lang": "en", "source": "a", "n_chars": 2 ** 63 - 1},
        {"doc_id": -3, "text": "wörter 😀 " * 50_000, "lang": "en", "source": "a", "n_chars": 1},
        {"doc_id": 14, "text": "x", "lang": "", "source": "a", "n_chars": 2 ** 63 - 1},
    ]
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in (
        "leaf", "tree", "rank", "seg", "idx", "grp", "digest", "bad", "path", "levels", "children", "root")})
    assert proofs(df) == brute(rows)


def test_empty_table(spark):
    assert proofs(spark.createDataFrame([], DOCS)) == []
