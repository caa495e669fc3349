import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from compare import differences
from pngs import blocks, png_bytes
from strandcut.functions import geometry as G
from strandcut.operators import pixels as P
from strandcut.plans import extract, locate
from strandcut.plans.catalog import ORACLES, QUERIES
from strandcut.schemas import LINES
from strandcut.sources import images, tables


def lines_of(spark, **named):
    rows = [(name, "d", a.shape[0], a.shape[1], bytearray(a.tobytes())) for name, a in named.items()]
    return spark.createDataFrame(rows, LINES)


def picture(row):
    return np.frombuffer(row.px, dtype=np.uint8).reshape(row.h, row.w)


def pictures(df):
    return {r.image_id: picture(r) for r in df.collect()}


class Batches:
    """Stands for a table of lines in one Arrow batch; a step on it gives its Arrow batches."""

    def __init__(self, schema, rows):
        self.schema = schema
        self.batch = pa.RecordBatch.from_pylist(rows, schema=pa.schema([
            ("image_id", pa.string()), ("dir", pa.string()), ("h", pa.int32()), ("w", pa.int32()), ("px", pa.binary())]))

    def mapInArrow(self, run, schema):
        return list(run(iter([self.batch])))


@pytest.mark.parametrize("step", [P.smooth, P.binarise, P.column_ink, P.strip_and_pad, P.slice_pixels, P.pad_sides])
def test_steps_hold_a_block_of_lines_at_a_time(step, monkeypatch):
    rng = np.random.default_rng(3)
    widths = [40, 1, 300, 25, 25, 25, 16, 60]
    rows = [
        {"image_id": str(i), "dir": None, "h": 20, "w": w, "px": rng.integers(0, 256, 20 * w).astype(np.uint8).tobytes()}
        for i, w in enumerate(widths)
    ]
    lines = Batches(LINES, rows)
    whole = step(lines)
    assert len(whole) == 1
    monkeypatch.setattr(P, "BLOCK_BYTES", 20 * 60)
    parts = step(lines)
    assert len(parts) == 5 and pa.Table.from_batches(parts).to_pylist() == whole[0].to_pylist()


def odd_lines():
    a = blocks(20, 40, (5, 9))
    rows = [("null", None, None), ("a", 40, a.tobytes()), ("empty", 0, b""), ("none", 40, None)]
    return Batches(LINES, [{"image_id": i, "dir": "d", "h": 20, "w": w, "px": px} for i, w, px in rows])


def by_id(parts):
    return {r["image_id"]: r for r in pa.Table.from_batches(parts).to_pylist()}


def test_blank_ends_of_lines_without_pixels():
    got = by_id(P.strip_and_pad(odd_lines()))
    assert (got["a"]["crop_beg"], got["a"]["crop_end"], got["a"]["h"], got["a"]["w"]) == (0, 24, 48, 28)
    assert (got["empty"]["h"], got["empty"]["w"], got["empty"]["px"]) == (48, 0, b"")
    for name, w in (("null", None), ("none", 40)):
        assert [got[name][c] for c in ("h", "w", "px", "crop_beg", "crop_end")] == [20, w, None, None, None]


def test_lines_without_pixels_have_no_slices():
    got = pa.Table.from_batches(P.slice_pixels(odd_lines())).to_pylist()
    assert [(r["image_id"], r["slice_no"]) for r in got] == [("a", i) for i in range(7)]


def test_slices_of_a_long_line_come_in_runs(monkeypatch):
    rng = np.random.default_rng(6)
    rows = [
        {"image_id": str(w), "dir": None, "h": 20, "w": w, "px": rng.integers(0, 256, 20 * w).astype(np.uint8).tobytes()}
        for w in (300, 17, 3, 64)
    ]
    whole = P.slice_pixels(Batches(LINES, rows))
    monkeypatch.setattr(P, "BLOCK_BYTES", 20 * 90)
    monkeypatch.setattr(P, "SET_BYTES", 4 * 20 * 90)
    parts = P.slice_pixels(Batches(LINES, rows))
    assert pa.Table.from_batches(parts).to_pylist() == pa.Table.from_batches(whole).to_pylist()
    assert len(parts) == 5 and max(sum(map(len, p["px"].to_pylist())) for p in parts) <= P.SET_BYTES


@pytest.mark.parametrize("step", [P.smooth, P.binarise, P.pad_sides, P.mark_centre, P.crop_and_pad, P.column_ink])
def test_steps_keep_lines_without_pixels(step):
    got = by_id(step(odd_lines()))
    out = "ink" if step is P.column_ink else "px"
    assert got["a"][out] and got["null"][out] is None and got["none"][out] is None
    assert [got[n]["w"] for n in ("null", "none")] == [None, 40] and got["none"]["h"] == 20
    assert step is P.pad_sides or len(got["empty"][out]) == 0


def test_long_lines_are_smoothed_in_strips(monkeypatch):
    a = np.random.default_rng(4).integers(0, 256, (9, 50)).astype(np.uint8)
    whole, level, taps = P.blur(a), P.otsu_level(a), P.gaussian_taps(1.3)
    wide = P.blur(a, taps)
    monkeypatch.setattr(P, "BLOCK_BYTES", 37)
    for n in (1, 3, 16):
        monkeypatch.setattr(P, "STRIP", n)
        assert (P.blur(a) == whole).all() and (P.blur(a, taps) == wide).all() and P.otsu_level(a) == level


def test_blur_by_hand():
    a = np.arange(35, dtype=np.uint8).reshape(5, 7) * 7
    k = np.array([1, 4, 6, 4, 1])
    kernel = np.outer(k, k) / 256.0
    wide = np.pad(a.astype(float), 2, mode="reflect")
    want = np.array([[(wide[y:y + 5, x:x + 5] * kernel).sum() for x in range(7)] for y in range(5)])
    assert np.abs(P.blur(a).astype(float) - want).max() <= 0.5 + 1e-9


@pytest.mark.parametrize("shape", [(1, 1), (1, 2), (2, 1), (2, 3), (3, 40)])
def test_blur_keeps_flat_pictures_of_any_size(shape):
    a = np.full(shape, 77, dtype=np.uint8)
    assert (P.blur(a) == 77).all()
    assert (P.blur(a, P.gaussian_taps(1.3)) == 77).all()


def test_resize_of_a_ramp_and_identity():
    ramp = np.repeat(np.arange(0, 200, 20, dtype=np.uint8)[:, None], 3, axis=1)
    up = P.resize_bilinear(ramp, 20, 3)
    assert up[0, 0] == 0 and up[-1, 0] == 180 and (np.diff(up[:, 0].astype(int)) >= 0).all()
    assert up[1, 0] == 5 and up[2, 0] == 15
    assert (P.resize_bilinear(ramp, 10, 3) == ramp).all()


def test_otsu_splits_two_levels():
    a = np.array([[10] * 6 + [200] * 3], dtype=np.uint8)
    assert P.otsu_level(a) == 10
    assert P.threshold(a).tolist() == [[0] * 6 + [255] * 3]
    assert P.otsu_level(np.full((3, 3), 255, dtype=np.uint8)) == 0


def test_otsu_against_all_levels():
    a = np.random.default_rng(1).integers(0, 256, (9, 31)).astype(np.uint8)

    def spread(t):
        low, high = a[a <= t].astype(float), a[a > t].astype(float)
        return 0 if not low.size or not high.size else low.size * high.size * (low.mean() - high.mean()) ** 2

    assert P.otsu_level(a) == max(range(256), key=lambda t: (round(spread(t), 3), -t))


@pytest.mark.parametrize(
    "image,want",
    [
        (blocks(20, 100, (40, 60)), (24, 75)),
        (blocks(20, 100, (3, 5), (90, 99)), (0, 99)),
        (blocks(20, 100), (84, 99)),
        (blocks(20, 10), (0, 9)),
    ],
)
def test_ink_bounds(image, want):
    assert P.ink_bounds(image) == want


@pytest.mark.parametrize("h", [40, 47, 48, 49, 64, 65, 80, 81, 100])
def test_heights(spark, h):
    df = lines_of(spark, a=blocks(h, 33, (5, 9)))
    fitted = pictures(P.fit_height(df))["a"]
    assert fitted.shape == ((128 if h > 80 else 64), 33)
    upload = pictures(P.crop_and_pad(df))["a"]
    assert upload.shape == (48, 33)
    if h < 48:
        corpus = pictures(P.strip_and_pad(df))["a"]
        assert corpus.shape[0] == 48 and corpus.shape[1] % 4 == 0
    assert df.select(G.target_height(F.col("h")).alias("t")).first().t == fitted.shape[0]


@pytest.mark.parametrize("w", [1, 12, 15, 16, 17, 64])
def test_slices_of_any_width(spark, w):
    a = np.arange(3 * w, dtype=np.uint8).reshape(3, w)
    got = P.slice_pixels(lines_of(spark, a=a)).collect()
    assert len(got) == max(0, (w - 16) // 4 + 1)
    for r in got:
        assert (r.beg, r.end) == (4 * r.slice_no, 4 * r.slice_no + 15)
        assert (picture(r) == a[:, r.beg:r.end + 1]).all()


def test_pads_marks_and_cuts(spark):
    df = lines_of(spark, a=blocks(10, 20, (5, 9)), b=blocks(10, 20))
    padded = pictures(P.pad_sides(df))
    assert padded["a"].shape == (10, 36) and (padded["a"][:, :8] == 255).all() and (padded["a"][:, -8:] == 255).all()
    marked = pictures(P.mark_centre(df))
    assert (marked["b"][:, 10] == 0).all() and (np.delete(marked["b"], 10, axis=1) == 255).all()
    cuts = spark.createDataFrame([("a", 3), ("a", 3), ("a", 19), ("a", 25)], "image_id string, x bigint")
    drawn = pictures(P.draw_cuts(df, cuts))
    assert (drawn["a"][:, [3, 19]] == 0).all() and (drawn["b"] == 255).all()
    small = pictures(P.fit_slice(df))
    assert small["a"].shape == (64, 16)


def test_random_smooth_is_repeatable(spark):
    df = lines_of(spark, a=blocks(10, 20, (5, 9)), b=blocks(10, 20, (5, 9)))
    one, two = pictures(P.random_smooth(df, 1)), pictures(P.random_smooth(df.repartition(3), 1))
    assert all((one[k] == two[k]).all() for k in one)
    assert (one["a"] != pictures(P.random_smooth(df, 2))["a"]).any() or (one["a"] != one["b"]).any()


def test_profile_operators_agree_with_the_kernels(spark):
    """The long-form operators see the same ends and the same smoothing."""
    from strandcut.operators import profiles

    a = blocks(20, 60, (20, 30), (33, 41))
    rows = [("a", x, y, int(a[y, x])) for x in range(60) for y in range(20)]
    px = spark.createDataFrame(rows, "image string, x int, y int, v int")
    widths = spark.createDataFrame([("a", 60)], "image string, w int")
    profile = profiles.ink_profile(px, "image", "x", F.col("v") == 0, widths, "w")
    assert {r.x: r.ink for r in profile.collect()} == dict(enumerate((a == 0).sum(axis=0).tolist()))
    assert tuple(profiles.strip_ends(profile, "image").first()[1:]) == P.ink_bounds(a)
    blank = spark.createDataFrame([("e", x, 0, 60) for x in range(60)], "image string, x bigint, ink bigint, width bigint")
    assert tuple(profiles.strip_ends(blank, "image").first()[1:]) == P.ink_bounds(blocks(20, 60))
    assert {r.threshold for r in profiles.otsu(px, "image", "v").collect()} == {P.otsu_level(a)}
    for width in (1, 2, 3, 9):
        values = [(x * 7) % 5 for x in range(width)]
        df = spark.createDataFrame([("a", x, v) for x, v in enumerate(values)], "image string, x bigint, ink bigint")
        got = [r.smooth for r in profiles.smooth_profile(df, "image").orderBy("x").collect()]
        padded = values
        if width > 1:
            period = 2 * (width - 1)
            at = [abs(i) % period for i in range(-2, width + 2)]
            padded = [values[period - i if i >= width else i] for i in at]
        else:
            padded = values * 5
        want = [sum(w * padded[i + k] for k, w in enumerate((1, 4, 6, 4, 1))) / 16 for i in range(width)]
        assert got == pytest.approx(want)


@pytest.fixture()
def image_dir(tmp_path):
    rng = np.random.default_rng(7)
    for d, count in (("one", 3), ("two", 2)):
        (tmp_path / d).mkdir()
        for i in range(count):
            image = blocks(40 + 30 * i, 50 + 13 * i, (6, 20), (30, 44))
            (tmp_path / d / f"s{i}.png").write_bytes(png_bytes(image))
    colour = rng.integers(0, 256, (9, 20, 3)).astype(np.uint8)
    (tmp_path / "two" / "colour.png").write_bytes(png_bytes(colour))
    (tmp_path / "two" / "broken.png").write_bytes(b"no picture")
    return tmp_path, colour


def test_scan(spark, image_dir):
    root, colour = image_dir
    got = {r.image_id.rsplit("/", 2)[-2:][0] + "/" + r.image_id.rsplit("/", 1)[-1]: r for r in images.scan_lines(spark, str(root)).collect()}
    assert set(got) == {"one/s0.png", "one/s1.png", "one/s2.png", "two/s0.png", "two/s1.png", "two/colour.png"}
    assert (picture(got["one/s1.png"]) == blocks(70, 63, (6, 20), (30, 44))).all()
    want = np.rint(colour @ np.array([0.299, 0.587, 0.114]))
    assert np.abs(picture(got["two/colour.png"]).astype(float) - want).max() <= 1
    assert images.scan_lines(spark, str(root), prefix="s").count() == 5
    assert images.scan_lines(spark, str(root), max_h=48).count() == 3


def test_bad_images_are_listed(spark, image_dir):
    root, _ = image_dir
    assert [(r.image_id.rsplit("/", 1)[-1], r.dir.rsplit("/", 1)[-1]) for r in images.bad_images(spark, str(root)).collect()] == [("broken.png", "two")]
    assert images.bad_images(spark, str(root), prefix="s").count() == 0
    with pytest.raises(Exception, match="bad image"):
        images.scan_raw_lines(spark, str(root), max_h=48, strict=True).collect()


def test_predicted_index_of_a_rerun(spark, tmp_path):
    path = str(tmp_path / "predicted")
    first = [("a: b/c", 0, 1), ("kept", 0, 1), ("other", 3, 1), ("never", 0, 0)]
    second = [("a: b/c", 0, 0), ("kept", 0, 0), ("kept", 1, 1), ("never", 0, 0)]
    for rows in (first, second):
        tables.write_predicted_index(spark.createDataFrame(rows, "dir string, idx int, label int"), path, "dir", "idx", "label")
    assert sorted(tuple(r) for r in tables.read_lines(spark, path, "dir").collect()) == [("1", "kept"), ("3", "other")]


def test_a_run_that_fails_midway_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "predicted")
    assert tables.read_lines(spark, path, "dir").count() == 0
    rows = spark.createDataFrame([(f"d/{i % 3}", i, 1) for i in range(300)] + [(None, 7, 1)], "dir string, idx int, label int")
    tables.write_predicted_index(rows, path, "dir", "idx", "label")
    before = sorted(map(tuple, tables.read_lines(spark, path, "dir").collect()), key=repr)
    assert len(before) == 301 and ("7", None) in before
    # Ranges are known when the first files are written; the last one fails.
    late = F.when(F.col("idx") == 299, F.raise_error(F.lit("lost")).cast("int")).otherwise(F.col("idx"))
    lines = rows.repartition(4).withColumn("line", late.cast("string"))
    with pytest.raises(Exception, match="lost"):
        tables._write_run(lines, rows, path, "dir", "idx", "line")
    assert sorted(map(tuple, tables.read_lines(spark, path, "dir").collect()), key=repr) == before
    tables.write_predicted_index(rows.withColumn("label", F.lit(0)).where("dir = 'd/1'"), path, "dir", "idx", "label")
    left = {r.dir for r in tables.read_lines(spark, path, "dir").collect()}
    assert left == {"d/0", "d/2", None}
    assert tables.commits(spark, path).count() == 2


def ink_model():
    """Label 1 where the middle of a slice is white: a stand-in for a trained network."""

    def make():
        def predict(x):
            middle = x.reshape(len(x), 64, 16)[:, :, 6:10].mean(axis=(1, 2))
            # Pixels come in as (value - mean) / std.
            return np.stack([np.full(len(x), 200.0 / 0.229), middle], axis=1)

        return predict

    return make


def test_from_images_to_spans_and_sheets(spark, image_dir, tmp_path):
    root, _ = image_dir
    tables.write_dataset(images.scan_lines(spark, str(root), prefix="s"), str(tmp_path / "out" / "lines"))
    lines = extract.number_lines(tables.read_dataset(spark, str(tmp_path / "out" / "lines"))).cache()
    slices = extract.with_index(extract.directory_slices(lines))
    scored = locate.score(slices, ink_model()).cache()

    for d, n in (("one", 3), ("two", 2)):
        idx = sorted(r.idx for r in scored.where(F.col("dir") == d).collect())
        assert idx == list(range(len(idx))) and len(idx) == sum((50 + 13 * i) // 4 + 1 for i in range(n))

    spans = locate.line_spans(scored).collect()
    per_line = {}
    for r in spans:
        per_line.setdefault(r.image_id, []).append((r.span_no, r.beg, r.end))
    assert len(per_line) == 5
    for found in per_line.values():
        found.sort()
        assert [n for n, _, _ in found] == [0, 1]
        (_, a, b), (_, c, d) = found
        assert a <= 6 and 20 <= b <= c + 4 and d >= 44 - 6

    cuts = locate.line_cuts(scored)
    drawn = locate.overlays(lines, scored)
    for r in drawn.collect():
        xs = {c.x for c in cuts.where(F.col("image_id") == r.image_id).collect()}
        assert xs and (picture(r)[:, sorted(xs)] == 0).all()

    sheet = locate.sheets(scored, lines)
    tables.write_contact_sheet(sheet, str(tmp_path / "out" / "sheet"), "dir")
    parts = sorted((tmp_path / "out" / "sheet" / "lines").glob("run=*/dir=one/part*"))
    text = "".join(p.read_text() for p in parts)
    assert text.startswith("<!DOCTYPE html>") and text.rstrip().endswith("</html>")
    assert text.count("<img") == scored.where("dir = 'one'").count()
    assert text.index("word_seg_0000") < text.index("word_seg_0001") < text.index("word_seg_0010")
    tables.write_predicted_index(scored, str(tmp_path / "out" / "predicted"), "dir", "idx", "label")
    parts = sorted((tmp_path / "out" / "predicted" / "lines").glob("run=*/dir=two/part*"))
    listed = [int(v) for p in parts for v in p.read_text().split()]
    assert listed == sorted(r.idx for r in scored.where("dir = 'two' and label = 1").collect())


def test_both_ways_of_scoring_agree(spark):
    from strandcut.functions.vectors import normalise
    from strandcut.operators import scoring

    rng = np.random.default_rng(3)
    df = P.slice_pixels(lines_of(spark, **{f"n{i}": rng.integers(0, 256, (6, 300)).astype(np.uint8) for i in range(9)}))
    model = scoring.linear_model(rng.normal(size=(2, 96)), rng.normal(size=2))
    a = scoring.score_pixels(df, model, mean=0.485, std=0.229, batch_size=7)
    floats = P.to_floats(df).withColumn("pixels", normalise(F.col("pixels")))
    b = scoring.score_slices(floats, ["pixels"], [96], model)
    got = {(r.image_id, r.slice_no): r.scores for r in a.collect()}
    want = {(r.image_id, r.slice_no): r.scores for r in b.collect()}
    assert len(got) == 9 * 72 and got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k], rtol=1e-4, atol=1e-2) for k in got)


def test_resizing_a_line_resizes_its_slices(spark):
    rng = np.random.default_rng(5)
    df = lines_of(spark, a=rng.integers(0, 256, (128, 61)).astype(np.uint8), b=rng.integers(0, 256, (64, 30)).astype(np.uint8))
    one = {(r.image_id, r.slice_no): r.px for r in P.fit_slice(P.slice_pixels(df)).collect()}
    two = {(r.image_id, r.slice_no): r.px for r in P.slice_pixels(P.map_images(df, P.to_slice_height)).collect()}
    assert one == two and len(one) == 12 + 4


def test_corpus_and_upload_slices(spark, image_dir):
    root, _ = image_dir
    lines = images.scan_lines(spark, str(root), prefix="s")
    corpus = extract.corpus_slices(lines).collect()
    assert {r.h for r in corpus} == {48} and len({r.image_id for r in corpus}) == 2
    for r in corpus:
        assert (r.crop_beg, r.crop_end) == (0, 49)
    upload = extract.upload_slices(lines).collect()
    assert len({r.image_id for r in upload}) == 5 and {(r.h, r.w) for r in upload} == {(48, 16)}


def documents_of(spark, path, texts):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint") \
        .coalesce(1).write.parquet(str(path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    return con


TEXTS = [None, "", "abc", "Zeile mit Wörtern ✓ " * 30, " " * 400, None, ""]


def test_crop_of_documents_without_characters(spark, tmp_path):
    con = documents_of(spark, tmp_path, TEXTS)
    assert not differences(QUERIES["picture_crop"](spark, str(tmp_path)), con, ORACLES["picture_crop"])


def test_ink_of_documents_without_characters(spark, tmp_path):
    con = documents_of(spark, tmp_path, TEXTS)
    assert not differences(QUERIES["picture_ink"](spark, str(tmp_path)), con, ORACLES["picture_ink"])


def test_slices_of_documents_without_characters(spark, tmp_path):
    con = documents_of(spark, tmp_path, TEXTS)
    assert not differences(QUERIES["picture_slices"](spark, str(tmp_path)), con, ORACLES["picture_slices"])
