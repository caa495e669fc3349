import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandcut.functions import geometry as G
from strandcut.functions import schedule
from strandcut.functions import vectors as V
from strandcut.operators import contrast, metrics, review, sampling, scoring, selection, slicing
from strandcut.plans import prepare
from strandcut.plans.catalog import QUERIES
from strandcut.plans.steps import apply_steps
from strandcut.sources import tables


@pytest.mark.parametrize("n,fraction", [(0, 0.3), (1, 0.3), (10, 0.01), (99, 0.2), (257, 0.3), (257, 1.0), (50, 0.0)])
@pytest.mark.parametrize("options", [{"digits": 1, "small": 1}, {"digits": 1, "small": 10}, {}])
def test_split_is_exact_whole_and_repeatable(spark, n, fraction, options):
    df = spark.range(n)
    a = {r.id: r.is_test for r in sampling.train_test_split(df, "id", fraction, 5, **options).collect()}
    assert set(a) == set(range(n)) and sum(a.values()) == math.ceil(round(fraction * n, 6))
    ranked = sorted(a, key=lambda i: hashlib.md5(f"5:{i}".encode()).hexdigest())
    assert all(a[i] for i in ranked[:sum(a.values())])


def test_split_does_not_shuffle_rows(spark):
    df = sampling.train_test_split(spark.range(1000), "id", 0.3, 5, digits=1, small=1)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


@pytest.mark.parametrize("options", [{"pivots": 7, "small": 5}, {"pivots": 255, "small": 1}, {}])
def test_rows_at_any_place(spark, options):
    rnd = random.Random(3)
    rows = [(rnd.choice([None, "a", "b", "é", ""]), rnd.choice([None, *range(40)]), float(i % 50)) for i in range(600)]
    rows += [("c", 7, 1.0)] * 300  # Equal rows, more than one range can hold.
    df = spark.createDataFrame(rows, "k string, n int, v double").repartition(5)
    first = lambda v: (v is not None, v if v is not None else 0)
    want = sorted(((r[0], r[1]) for r in rows), key=lambda r: ((r[0] is not None, (r[0] or "").encode()), first(r[1])))
    for at, n in ((0, 1), (0, 5), (597, 9), (610, 250), (899, 1), (890, 40), (900, 3), (5000, 2), (0, 900)):
        got = sampling.slice_at(df, ["k", "n"], at, n, **options).orderBy("idx").collect()
        assert [r.idx for r in got] == list(range(at, min(900, at + n)))
        assert [(r.k, r.n) for r in got] == want[at:at + n]
    none = df.limit(0)
    assert sampling.slice_at(none, ["k"], 0, 4, **options).count() == 0


def test_all_places_together_are_the_table(spark):
    df = spark.createDataFrame([(i % 3, i % 2, i // 4) for i in range(200)], "a int, b int, c int").repartition(4)
    got = [tuple(r)[:3] for at in range(0, 200, 40) for r in sampling.slice_at(df, ["a"], at, 40, pivots=3, small=2).collect()]
    assert sorted(got) == sorted(map(tuple, df.collect()))


def test_rows_at_sorts_one_range_only(spark):
    df = spark.range(5000).withColumn("v", F.pmod(F.col("id") * 37, F.lit(5000)))
    part, before, rows = selection.place_range(df, ["v"], 2500, 10, pivots=63, small=50)
    assert rows <= 60 and part.count() == rows and part.where("v < 2500").count() == 2500 - before
    plan = sampling.slice_at(df, ["v"], 2500, 10, pivots=63, small=50)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan


@pytest.mark.parametrize("times", [0, 1, 3])
def test_oversample_size(spark, times):
    df = spark.range(20).withColumn("flag", F.col("id") < 6)
    assert sampling.oversample(df, F.col("flag"), times).count() == 20 + 6 * (times - 1)


def test_caps_and_lookups(spark):
    df = spark.range(1000).withColumn("v", F.col("id") * 2).repartition(7)
    assert sorted(r.id for r in sampling.sample_cap(df, "id", 20).collect()) == list(range(20))
    assert sorted(r.id for r in sampling.preview(df, "id", 200).collect()) == list(range(200, 232))
    assert [(r.id, r.idx) for r in sampling.slice_at(df, ["id"], 17).collect()] == [(17, 17)]
    got = sorted((r.id, r.idx) for r in sampling.slice_at(df, ["v"], 500, 3).collect())
    assert got == [(500, 500), (501, 501), (502, 502)]


@pytest.mark.parametrize("w", [0, 1, 15, 16, 17, 19, 20, 64])
def test_slice_counts_and_windows(spark, w):
    df = spark.createDataFrame([(w,)], "w int")
    got = [(r.beg, r.end) for r in slicing.slice_windows(df, "w").collect()]
    want, beg = [], 0
    while beg + 15 < w:
        want.append((beg, beg + 15))
        beg += 4
    assert got == want and df.select(G.slice_count(F.col("w")).alias("n")).first().n == len(want)


@pytest.mark.parametrize("size,step", [(16, 4), (6, 3), (5, 5)])
def test_text_slices(spark, size, step):
    texts = ["", "x" * 15, "abcdefghijklmnopqrstuvwxyz0123", "line\nbreaks\tand ünïcödé 漢字漢字漢字 text"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {(r.id, r.slice_no, r.piece) for r in slicing.slice_text(df, "t", size=size, step=step).collect()}
    assert got == {
        (i, k, t[k * step:k * step + size]) for i, t in enumerate(texts) for k in range((len(t) - size) // step + 1)
    }


def test_text_slices_listed_in_their_row(spark):
    texts = [None, "", "x" * 15, "abcdefghijklmnopqrstuvwxyz0123", "  ünïcödé 漢字漢字漢字 text  "]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    rows = slicing.slice_text(df, "t").collect()
    assert {r.id: r.pieces for r in slicing.slice_text(df, "t", listed=True).collect()} == {
        i: None if t is None else [p for _, p in sorted((r.slice_no, r.piece) for r in rows if r.id == i)]
        for i, t in enumerate(texts)
    }


def test_slice_payload_sorts_no_slices(spark, tmp_path):
    # Ids that repeat or are null, texts without a slice beside others of their document.
    rows = [(1, "abcdefghijklmnopqrstuvwx"), (1, None), (1, " " * 20), (2, "short"), (3, None), (None, "y" * 16), (None, "z" * 21)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["slice_payload"](spark, str(tmp_path))
    assert {tuple(r) for r in out.collect()} == {
        (1, 5, " " * 16, "ijklmnopqrstuvwx", 48), (None, 3, "y" * 16, "z" * 16, 48),
    }
    # Nothing but one row a text may reach the sort of the string aggregate.
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()


def test_origin_x_is_clamped_with_floor_division(spark):
    df = spark.createDataFrame([(0, 15, 20), (4, 19, 20), (40, 55, 20), (0, 15, 1)], "b int, e int, w int")
    got = [r.x for r in df.select(G.to_origin_x(F.col("b"), F.col("e"), F.col("w")).alias("x")).collect()]
    assert got == [max(0, min(w - 1, (b + e - 16) // 2)) for b, e, w in ((0, 15, 20), (4, 19, 20), (40, 55, 20), (0, 15, 1))]


def scored_rows(seed, n):
    rnd = random.Random(seed)
    return [(i, rnd.randint(0, 1), rnd.randint(0, 1), rnd.uniform(-50, 50), rnd.uniform(-50, 50)) for i in range(n)]


def test_metrics(spark):
    rows = scored_rows(1, 130)
    df = spark.createDataFrame(rows, "i bigint, y int, p int, z0 double, z1 double").withColumn("b", F.floor(F.col("i") / 50))
    tp = sum(y & p for _, y, p, _, _ in rows)
    fp, fn = sum(p for _, _, p, _, _ in rows) - tp, sum(y for _, y, _, _, _ in rows) - tp
    assert tuple(metrics.confusion(df, "y", "p").first()) == (tp, fp, fn, len(rows) - tp - fp - fn)
    assert metrics.recall(df, "y", "p").first()[0] == pytest.approx(tp / (tp + fn))
    assert metrics.precision(df, "y", "p").first()[0] == pytest.approx(tp / (tp + fp))
    accs = [np.mean([y == p for _, y, p, _, _ in rows[b:b + 50]]) for b in (0, 50, 100)]
    assert tuple(metrics.accuracy_batch_mean(df, "y", "p", "b").first()) == (3, pytest.approx(np.mean(accs)))

    def loss(part):
        w = [0.7 if y else 0.3 for _, y, *_ in part]
        nll = [np.logaddexp(z0, z1) - (z1 if y else z0) for _, y, _, z0, z1 in part]
        return np.dot(w, nll) / np.sum(w)

    assert metrics.weighted_ce(df, "y", "z0", "z1").first()[0] == pytest.approx(loss(rows))
    mean = np.mean([loss(rows[b:b + 50]) for b in (0, 50, 100)])
    assert metrics.loss_batch_mean(df, "y", "z0", "z1", "b").first().loss == pytest.approx(mean)


def test_empty_metrics_are_zero(spark):
    df = spark.createDataFrame([], "y int, p int")
    assert tuple(metrics.rates(metrics.confusion(df, "y", "p")).first()) == (0, 0, 0, 0, 0.0, 0.0, 0.0)


def test_decays(spark):
    df = spark.range(30)
    for r in df.select("id", schedule.cosine_decay(F.col("id"), 0.1, 21).alias("c"),
                       schedule.milestone_decay(F.col("id"), 0.1, [5, 20]).alias("m")).collect():
        assert r.c == pytest.approx(0.05 * (1 + math.cos(math.pi * r.id / 21)))
        assert r.m == pytest.approx(0.1 * 0.1 ** ((r.id >= 5) + (r.id >= 20)))


def unit(rng, n, d):
    v = rng.normal(size=(n, d))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def test_contrast_by_hand(spark):
    rng = np.random.default_rng(2)
    q, k, keys = unit(rng, 300, 8), unit(rng, 300, 8), unit(rng, 50, 8)
    df = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(q, k))], "i bigint, q array<double>, k array<double>")
    bank_df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(keys)], "seq bigint, v array<double>")
    newest = contrast.key_bank(bank_df, "seq", 32)
    assert {(r.seq, r.slot) for r in newest.collect()} == {(i, i % 32) for i in range(18, 50)}
    bank = contrast.bank_places(newest, "v")
    ring = np.concatenate([keys[32:], keys[18:32]])
    assert [(r.place, r.vec) for r in bank.orderBy("place").collect()] == [(i, v.tolist()) for i, v in enumerate(ring)]
    z = np.concatenate([(q * k).sum(1, keepdims=True), q @ ring.T], axis=1) / 0.07
    want = np.log(np.exp(z - z.max(1, keepdims=True)).sum(1)) + z.max(1) - z[:, 0]
    # One block of the bank or seven, queries in one part or many: the same figures.
    for blocks in ({}, {"key_rows": 5, "query_rows": 40}):
        got = {r.i: r for r in contrast.contrastive_logits(df, ["i"], "q", "k", bank, **blocks).collect()}
        assert len(got) == 300 and all(r.n_keys == 32 for r in got.values())
        rows = np.array([[got[i].l_pos, got[i].neg_max, got[i].neg_sum, got[i].loss] for i in range(300)])
        assert np.allclose(rows, np.stack([z[:, 0], z[:, 1:].max(1), z[:, 1:].sum(1), want], axis=1))
    loss = {r.i: r.loss for r in contrast.info_nce(df, "i", "q", "k", bank, key_rows=9).collect()}
    assert np.allclose([loss[i] for i in range(300)], want)
    none = contrast.bank_places(newest.where("false"), "v")
    alone = contrast.contrastive_logits(df, "i", "q", "k", none)
    assert alone.agg(F.count("loss"), F.max(F.abs("loss")), F.max("n_keys"), F.max("neg_max")).first() == (300, 0.0, 0, None)
    sees = df.select("i", "q", F.lit(0).cast("long").alias("since"), F.lit(32).cast("long").alias("until"))
    best = {(r.i, r.rank): (r.place, r.logit) for r in contrast.nearest_keys(sees, "i", bank, 3, key_rows=7).collect()}
    order = np.argsort(-z[:, 1:], axis=1)[:, :3]
    assert len(best) == 900 and all(best[i, j + 1][0] == order[i, j] for i in range(300) for j in range(3))


def test_losses_of_large_logits_do_not_overflow(spark):
    df = spark.createDataFrame([(0, [60.0], [1.0]), (1, [-60.0], [1.0])], "i bigint, q array<double>, k array<double>")
    bank = spark.createDataFrame([(i, [float(v)]) for i, v in enumerate([1, 1, -1, 0, 0.5])], "place bigint, vec array<double>")
    got = {r.i: r.loss for r in contrast.info_nce(df, "i", "q", "k", bank, key_rows=2).collect()}
    assert got[0] == pytest.approx(math.log(3)) and got[1] == pytest.approx(120 / 0.07)


@pytest.mark.parametrize("batch, size, held", [(4, 8, 0), (4, 8, 8), (5, 5, 3), (7, 7 * 40, 0)])
def test_bank_by_step_against_a_ring(spark, batch, size, held):
    """A ring that is read, then written, step by step."""
    rng = np.random.default_rng(batch)
    n = 61
    q, k, first = unit(rng, n, 6), unit(rng, n, 6), unit(rng, size, 6)
    seqs = sorted(random.Random(batch).sample(range(10 ** 9), n))
    df = spark.createDataFrame(
        [(s, a.tolist(), b.tolist()) for s, a, b in zip(seqs, q, k)], "seq bigint, q array<double>, k array<double>"
    ).repartition(4)
    ring = {i: first[i] for i in range(held)}
    start = spark.createDataFrame([(i, v.tolist()) for i, v in ring.items()], "slot int, vec array<double>") if held else None
    want = {}
    for t in range(0, n, batch):
        for i in range(t, min(n, t + batch)):
            pos, neg = q[i] @ k[i] / 0.07, np.array([q[i] @ v for v in ring.values()]) / 0.07
            loss = np.log(np.exp(pos) + np.exp(neg).sum()) - pos
            want[seqs[i]] = (t // batch, i % size, len(neg), pos, neg.max() if len(neg) else None, neg.sum(), loss)
        for i in range(t, min(n, t + batch)):
            ring[i % size] = k[i]
    got = contrast.bank_by_step(df, "seq", "q", "k", batch=batch, size=size, start=start, key_rows=6, query_rows=5)
    rows = {r.seq: (r.batch_id, r.slot, r.n_keys, r.l_pos, r.neg_max, r.neg_sum, r.loss) for r in got.collect()}
    assert rows.keys() == want.keys()
    for s in seqs:
        assert rows[s][:3] == want[s][:3]
        assert (rows[s][4] is None) == (want[s][4] is None)
        assert [v or 0.0 for v in rows[s][3:]] == pytest.approx([v or 0.0 for v in want[s][3:]], rel=1e-9, abs=1e-9)
    with pytest.raises(ValueError):
        contrast.bank_by_step(df, "seq", "q", "k", batch=4, size=6)


@pytest.mark.parametrize("size", [1, 7, 500, 5000])
def test_bank_of_gappy_arrival_numbers(spark, size):
    rnd = random.Random(9)
    seqs = rnd.sample(range(10_000_000), 600) + list(range(20_000_000, 20_000_400))
    df = spark.createDataFrame([(s,) for s in seqs], "seq bigint").repartition(5)
    got = contrast.key_bank(df, "seq", size).collect()
    assert sorted(r.seq for r in got) == sorted(seqs)[-size:]
    rank = {s: i for i, s in enumerate(sorted(seqs))}
    assert all(r.slot == rank[r.seq] % size for r in got)


def test_views_and_flips(spark):
    vec = [float(i) for i in range(8)]
    df = spark.range(400).withColumn("v", F.array(*[F.lit(x) for x in vec]))
    views = contrast.two_views(df, "id", "v", 3, width=4).collect()
    assert len(views) == 800
    mirrored = [3.0, 2.0, 1.0, 0.0, 7.0, 6.0, 5.0, 4.0]
    assert {tuple(r.v) for r in views} == {tuple(vec), tuple(mirrored)}
    share = sum(r.v == mirrored for r in views) / 800
    assert 0.4 < share < 0.6
    assert contrast.random_flip(df, "id", "v", 3, p=0.0).where(F.get("v", F.lit(0)) != 0.0).count() == 0
    assert contrast.random_flip(df, "id", "v", 3, p=1.0).where(F.get("v", F.lit(0)) != 7.0).count() == 0


def test_scoring_and_ties(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(600)], "i bigint, x array<double>")
    model = scoring.linear_model(np.array([[1.0, 0.0], [0.0, 300.0]]), np.zeros(2))
    got = scoring.label_slices(scoring.score_slices(df, ["x"], [2], model)).collect()
    assert all(r.label == (1 if r.i < 300 else 0) for r in got) and len(got) == 600
    fused = scoring.gated_fusion((np.zeros((2, 4)), np.zeros(2)), (np.zeros((2, 2)), np.array([50.0, -50.0])))
    mixed = scoring.score_slices(df.withColumn("y", F.array(F.lit(9.0), F.lit(9.0))), ["x", "y"], [2, 2], fused, "m")
    assert all(r.m == pytest.approx(r.x) for r in mixed.collect())


def test_classifier_saves_and_logs(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, int(v[0] > 0), v.tolist()) for i, v in enumerate(rng.normal(size=(300, 3)))]
    df = spark.createDataFrame(rows, "i bigint, y int, v array<double>")
    model = scoring.train_slice_classifier(df, "v", "y")
    curve = [r.value for r in prepare.training_log(spark, model).orderBy("step").collect()]
    assert len(curve) > 2 and curve[-1] < curve[0]
    assert tables.save_model(model, str(tmp_path), 0) is None
    assert tables.save_model(model, str(tmp_path), 3, every=2) is None
    path = tables.save_model(model, str(tmp_path), 4, every=2)
    assert path.endswith("epoch_004_model")
    loaded = tables.load_model(path)
    assert np.allclose(loaded.coefficients.toArray(), model.coefficients.toArray())
    for epoch in (1, 2):
        tables.log_metrics(prepare.evaluate(loaded, df, "v", "y", epoch, order="i", size=16), str(tmp_path / "log"))
    log = {(r.tag, r.step): r.value for r in spark.read.parquet(str(tmp_path / "log")).collect()}
    assert len(log) == 8 and log["eval/acc", 1] == log["eval/acc", 2] > 0.95


def test_sheet_rows_and_document(spark):
    df = spark.createDataFrame([("d", i) for i in range(90)], "dir string, idx bigint")
    laid = review.sheet_layout(df, "dir", "idx", bits=4)
    assert {(r.idx, r.row_no, r.col_no) for r in laid.collect()} == {(i, i // 41, i % 41) for i in range(90)}
    cells = laid.select("*", F.format_string("%04d", "idx").alias("i"), F.lit("01").alias("t"), F.lit("p.png").alias("p"))
    sheet = review.contact_sheet(cells, "dir", "i", "t", "p")
    rows = {r.row_no: r.html for r in sheet.collect()}
    assert set(rows) == {0, 1, 2} and rows[0].count("<img") == 41 and rows[2].count("<img") == 8
    assert '<td id="c01">01</td>' in rows[0] and "<td>000</td>" in rows[0] and "<td>089</td>" in rows[2]
    dirs = spark.createDataFrame([("d",), ("empty",)], "dir string")
    document = review.sheet_document(sheet, dirs, "dir").collect()
    assert len(document) == 3 + 2 * 2


def test_staging(spark, tmp_path):
    files = spark.createDataFrame([("in/7/sentence/a.b.png",), ("in/7/other/c.png",)], "path string")
    manifest = tables.stage_manifest(files, "path", "out")
    assert [r.target for r in manifest.collect()] == ["out/7_a.b/a.b.png"]
    tables.write_manifest(manifest, str(tmp_path / "m"))
    with pytest.raises(Exception, match="(?i)already exists"):
        tables.write_manifest(manifest, str(tmp_path / "m"))


def test_rerun_replaces_only_its_directories(spark, tmp_path):
    path = str(tmp_path / "s")
    tables.write_dataset(spark.createDataFrame([("a", 1), ("b", 2)], "dir string, v int"), path, partition_by=["dir"])
    tables.write_dataset(spark.createDataFrame([("b", 3)], "dir string, v int"), path, partition_by=["dir"])
    assert {(r.dir, r.v) for r in tables.read_dataset(spark, path).collect()} == {("a", 1), ("b", 3)}


def test_steps(spark):
    df = apply_steps(spark.range(3), [lambda d: d.withColumn("v", F.array(F.lit(3.0), F.lit(4.0))),
                                      lambda d: d.withColumn("v", V.l2_normalise(F.col("v")))])
    assert df.first().v == pytest.approx([0.6, 0.8])
