import random

import pytest
from pyspark.sql import functions as F

import brute
from strandcut.operators import ordering, sequences, slicing
from strandcut.operators.spans import char_spans, spans_json


def sparse_rows(seed, parts=30, longest=60, hot=400):
    """Parts of random length with gaps in the order column; one part is far larger."""
    rnd = random.Random(seed)
    rows = []
    for part in range(parts):
        n = hot if part == 7 else rnd.randint(1, longest)
        share = rnd.choice([0.05, 0.5, 0.95])
        for o in sorted(rnd.sample(range(3 * n + 5), n)):
            rows.append((part, o, int(rnd.random() < share), o * 3 + 1))
    rnd.shuffle(rows)
    return rows


def by_part(rows):
    out = {}
    for r in sorted(rows):
        out.setdefault(r[0], []).append(r[1:])
    return out


SCHEMA = "p int, o bigint, label int, x bigint"


@pytest.mark.parametrize("bits,hot_rows", [(1, 0), (3, 0), (6, 0), (20, 0), (3, 40), (5, 100), (3, 10**6)])
def test_spans_do_not_depend_on_the_chunk_size(spark, bits, hot_rows):
    rows = sparse_rows(1)
    want = {
        (p, i, beg, end)
        for p, items in by_part(rows).items()
        for i, (beg, end) in enumerate(brute.spans([(lab, x) for _, lab, x in items]))
    }
    got = char_spans(spark.createDataFrame(rows, SCHEMA), "p", "o", "label", "x", bits=bits, hot_rows=hot_rows).collect()
    assert len(got) == len(want)
    assert {tuple(r) for r in got} == want


@pytest.mark.parametrize("parts", [1, 7, 31])
def test_spans_do_not_depend_on_the_partitioning(spark, parts):
    df = spark.createDataFrame(sparse_rows(2), SCHEMA)
    a = {tuple(r) for r in char_spans(df.repartition(parts), "p", "o", "label", "x", bits=4, hot_rows=30).collect()}
    b = {tuple(r) for r in char_spans(df, "p", "o", "label", "x").collect()}
    assert a == b


def test_spans_of_a_part_are_ordered_and_apart(spark):
    df = spark.createDataFrame(sparse_rows(3), SCHEMA)
    got = by_part([tuple(r) for r in char_spans(df, "p", "o", "label", "x", bits=3, hot_rows=20).collect()])
    for items in got.values():
        assert [n for n, _, _ in items] == list(range(len(items)))
        assert all(a[2] <= b[1] or a[2] <= b[2] for a, b in zip(items, items[1:]))
        assert all(beg <= end for _, beg, end in items)


def test_spans_json_of_images_without_spans(spark):
    spans = spark.createDataFrame([("a", 0, 1, 2)], "img string, span_no bigint, beg int, end int")
    images = spark.createDataFrame([("a",), ("b",), ("b",)], "img string")
    got = sorted(tuple(r) for r in spans_json(spans, "img", images=images).collect())
    assert got == [("a", 0, "[[1,2]]"), ("b", 0, "[]")]


def test_spans_json_pages(spark):
    spans = spark.createDataFrame([("a", n, n * 10, n * 10 + 5) for n in range(5)], "img string, span_no bigint, beg bigint, end bigint")
    got = {(r.page_no, r.spans_json) for r in spans_json(spans, "img", page=3).collect()}
    assert got == {(0, "[[0,5],[10,15],[20,25]]"), (1, "[[30,35],[40,45]]")}


@pytest.mark.parametrize("bits,levels", [(1, 2), (2, 3), (3, 4), (20, 3)])
@pytest.mark.parametrize("part", [None, "p"])
def test_positions_of_sparse_64_bit_keys(spark, bits, levels, part):
    rnd = random.Random(4)
    keys = {rnd.randint(-(2**62), 2**62) for _ in range(300)} | set(range(40))
    rows = [(0 if i % 3 else i % 5, k) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "p int, o bigint")
    got = ordering.running_position(df, part, "o", "n", totals=part is None, bits=bits, carry_bits=bits + 1, levels=levels, hot_rows=20).collect()
    assert len(got) == len(rows)
    groups = by_part([(r.p if part else 0, r.o, r.n, r.n_total if part is None else None) for r in got])
    for items in groups.values():
        assert [n for _, n, _ in items] == list(range(len(items)))
        assert {t for _, _, t in items} == ({len(items)} if part is None else {None})


def test_running_mean_over_chunks(spark):
    df = spark.createDataFrame([(i, float(i % 7)) for i in range(100)], "b bigint, acc double")
    got = sequences.running_mean(df, "b", F.col("acc"), "mean", bits=2).collect()
    total = 0.0
    for i, r in enumerate(sorted(got)):
        total += i % 7
        assert r.mean == pytest.approx(total / (i + 1))


@pytest.mark.parametrize("parts", [1, 5])
def test_ordered_index_with_strings_and_ties(spark, parts):
    rnd = random.Random(5)
    rows = [("same" if i % 3 == 0 else rnd.choice("abc"), rnd.choice(["x", "y", "z"]), i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, l string, v int").repartition(parts)
    got = ordering.ordered_index(df, ["k", "l"], "n").collect()
    assert sorted(r.v for r in got) == list(range(300))
    got.sort(key=lambda r: r.n)
    assert [r.n for r in got] == list(range(300))
    assert [(r.k, r.l) for r in got] == sorted((k, l) for k, l, _ in rows)


@pytest.mark.parametrize("hot_rows", [0, 10, 10**6])
def test_numbers_of_copies(spark, hot_rows):
    rnd = random.Random(11)
    rows = [(rnd.randint(0, 2), rnd.randint(0, 40), rnd.randint(0, 3)) for _ in range(900)] + [(1, 7, 1)] * 70_000
    df = spark.createDataFrame(rows, "p int, a bigint, b bigint").repartition(8)
    cuts = [ordering.chunk_of("a", 3), F.col("a"), F.col("b")]
    got = ordering.number_copies(df, "p", ["a", "b"], "n", chunk=cuts, hot_rows=hot_rows).collect()
    assert len(got) == len(rows)
    for p, items in by_part([(r.p, r.n, r.a, r.b) for r in got]).items():
        assert [i[0] for i in items] == list(range(len(items)))
        assert [i[1:] for i in items] == sorted((a, b) for q, a, b in rows if q == p)


def test_ordered_index_spreads_copies(spark):
    df = spark.range(4000).select(F.when(F.col("id") % 3 > 0, "copy").otherwise(F.col("id").cast("string")).alias("k"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ordering.ordered_index(df.repartition(6), ["k"], "n")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted(r.n for r in got.collect()) == list(range(4000))
    copies = got.where("k = 'copy'").groupBy(F.spark_partition_id()).count().collect()
    assert len(copies) > 2


def test_hash_position_is_a_repeatable_shuffle(spark):
    df = spark.range(500)
    a = {r.id: r.pos for r in ordering.hash_position(df, "id", 1, chunk_rows=30).collect()}
    b = {r.id: r.pos for r in ordering.hash_position(df.repartition(9), "id", 1).collect()}
    assert a == b and sorted(a.values()) == list(range(500))
    assert a != {r.id: r.pos for r in ordering.hash_position(df, "id", 2).collect()}


@pytest.mark.parametrize("bits,hot_rows", [(2, 0), (3, 0), (3, 40), (20, 40), (20, 10**6)])
def test_context_crosses_chunk_borders(spark, bits, hot_rows):
    rows = sparse_rows(6, parts=10)
    df = spark.createDataFrame(rows, SCHEMA)
    got = sequences.context_features(df, "p", "o", "x", 2, bits=bits, hot_rows=hot_rows).collect()
    assert len(got) == len(rows)
    want = {}
    for p, items in by_part(rows).items():
        xs = [0, 0] + [x for _, _, x in items] + [0, 0]
        for i, (o, _, _) in enumerate(items):
            want[p, o] = (xs[i + 1], xs[i], xs[i + 3], xs[i + 4])
    assert {(r.p, r.o): (r.x_prev1, r.x_prev2, r.x_next1, r.x_next2) for r in got} == want


@pytest.mark.parametrize("hot_rows", [None, 0, 50, 1000])
@pytest.mark.parametrize("chunk", [False, True])
def test_only_hot_parts_are_cut(spark, hot_rows, chunk):
    rows = [r[:3] for r in sparse_rows(8)] + [(None, o, 0) for o in range(5)]
    df = spark.createDataFrame(rows if hot_rows is not None else [r for r in rows if r[0] is not None], "p int, o bigint, label int")
    order = ["label", "o"] if chunk else "o"
    cuts = [F.col("label"), F.shiftright("o", 3)] if chunk else None
    got = ordering.running_position(df, "p", order, "n", chunk=cuts, bits=3, hot_rows=hot_rows).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.p, []).append(((r.label, r.o) if chunk else r.o, r.n))
    assert sum(map(len, groups.values())) == df.count()
    for p, items in groups.items():
        if p is not None:
            assert [n for _, n in sorted(items)] == list(range(len(items)))


@pytest.mark.parametrize("hot_rows", [0, 20, 10**6])
def test_context_vectors(spark, hot_rows):
    rows = [(p, o, [float(p), float(o)]) for p, n in ((1, 30), (2, 1), (3, 9)) for o in range(n)]
    df = spark.createDataFrame(rows, "p int, o bigint, v array<float>")
    got = sequences.context_vectors(df, "p", "o", "v", 2, 2, bits=2, hot_rows=hot_rows).collect()
    known = {(p, o): v for p, o, v in rows}
    assert len(got) == 40
    for r in got:
        assert r.context == [x for d in (-2, -1, 0, 1, 2) for x in known.get((r.p, r.o + d), [0.0, 0.0])]


@pytest.mark.parametrize("n", [0, 1, 79, 80, 81, 120, 121, 333])
@pytest.mark.parametrize("include_last", [False, True])
def test_count_windows(spark, n, include_last):
    df = spark.range(n).withColumnRenamed("id", "o")
    got = sequences.count_windows(df, "o", include_last=include_last, bits=5).collect()
    want = {(i, k, beg + k) for i, beg in enumerate(brute.windows(n, 80, 40, include_last)) for k in range(80)}
    assert {(r.window_id, r.item_no, r.o) for r in got} == want and len(got) == len(want)


def test_count_windows_within_directories(spark):
    rows = [(d, i) for d, n in ((0, 9), (1, 3), (2, 30)) for i in range(n)]
    df = spark.createDataFrame(rows, "d int, o bigint")
    got = sequences.count_windows(df, "o", size=4, step=2, part="d", bits=2).collect()
    want = {(d, i, k, beg + k) for d, n in ((0, 9), (1, 3), (2, 30)) for i, beg in enumerate(brute.windows(n, 4, 2)) for k in range(4)}
    assert {(r.d, r.window_id, r.item_no, r.o) for r in got} == want


def test_pack_and_flatten_round_trip(spark):
    df = spark.range(300).select(F.col("id").alias("o"), (F.col("id") % 3).alias("t"))
    windows = sequences.count_windows(df, "o")
    packed = sequences.sequence_pack(windows, ["o", "t"])
    assert all([x.o for x in r["items"]] == list(range(r.window_id * 40, r.window_id * 40 + 80)) for r in packed.collect())
    flat = sequences.flatten_sequences(packed, ["window_id"]).select("window_id", "item_no", "o", "t")
    assert sorted(flat.collect()) == sorted(windows.select("window_id", "item_no", "o", "t").collect())


def test_collect_columns_pages_in_order(spark):
    rows = [(c, t, f"{c}-{t}") for c in (1, 2) for t in range(7 * c)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "c int, t bigint, s string")
    got = {(r.c, r.page_no): r.s for r in sequences.collect_columns(df, "c", "t", ["s"], page=5).collect()}
    assert got[1, 0] == [f"1-{t}" for t in range(5)] and got[1, 1] == ["1-5", "1-6"]
    assert got[2, 2] == [f"2-{t}" for t in range(10, 14)]


def test_image_numbers_come_from_widths(spark):
    rows = [("a", "a/2", 20), ("a", "a/1", 16), ("b", "b/1", 3), ("a", "a/3", 64)]
    df = spark.createDataFrame(rows, "dir string, path string, w int")
    got = {r.path: r.first_no for r in slicing.number_images(df, "dir", "path", "w", pad=0).collect()}
    assert got == {"a/1": 0, "a/2": 1, "a/3": 3, "b/1": 0}
