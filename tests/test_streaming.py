import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from pngs import blocks, png_bytes
from strandcut.operators import pixels as P
from strandcut.operators.spans import char_spans
from strandcut.plans import extract
from strandcut.sources.images import scan_lines
from strandcut.streaming.landing import detect_stream, read_landing, read_landing_lines
from strandcut.streaming.runs import current_spans, fold_chunk, track_runs

SCHEMA = "img int, slice_no bigint, label int, mid bigint"


def rows(images):
    return [(i, s, (i * s) % 3 % 2, s * 4 + 7) for i in images for s in range(40)]


def as_set(df):
    return {(r.img, r.span_no, r.beg, r.end) for r in df.collect()}


def test_stream_of_predictions_equals_batch(spark, tmp_path):
    land, out = str(tmp_path / "land"), str(tmp_path / "out")

    def run():
        stream = read_landing(spark, land, spark.createDataFrame([], SCHEMA).schema, max_files=1)
        detect_stream(stream, "img", "slice_no", "label", "mid", out, str(tmp_path / "state")).awaitTermination()
        return spark.read.parquet(out)

    spark.createDataFrame(rows([1, 2]), SCHEMA).coalesce(1).write.mode("append").parquet(land)
    spark.createDataFrame(rows([3]), SCHEMA).coalesce(1).write.mode("append").parquet(land)
    first = run()
    assert as_set(first) == as_set(char_spans(spark.read.parquet(land), "img", "slice_no", "label", "mid"))
    spark.createDataFrame(rows([4, 5]), SCHEMA).coalesce(1).write.mode("append").parquet(land)
    again = run()
    assert again.count() == len(as_set(again))
    assert as_set(again) == as_set(char_spans(spark.read.parquet(land), "img", "slice_no", "label", "mid"))


def test_stream_of_images_equals_batch(spark, tmp_path):
    land = tmp_path / "land"
    land.mkdir()
    for i in range(3):
        (land / f"s{i}.png").write_bytes(png_bytes(blocks(30, 60 + i, (10, 25), (35, 50))))

    def labelled(lines):
        # A slice is white when none of its middle columns has ink.
        slices = P.to_floats(extract.upload_slices(lines))
        middle = F.aggregate(F.transform("pixels", lambda v, i: F.when((i % 16).between(6, 9), v).otherwise(255.0).cast("double")),
                             F.lit(255.0), lambda a, b: F.least(a, b))
        return slices.select("image_id", "slice_no", (middle > 128).cast("int").alias("label"), (F.col("beg") + 7).alias("mid"))

    out = str(tmp_path / "out")
    detect_stream(read_landing_lines(spark, str(land)), "image_id", "slice_no", "label", "mid",
                  out, str(tmp_path / "state"), prepare=labelled).awaitTermination()
    want = char_spans(labelled(scan_lines(spark, str(land))), "image_id", "slice_no", "label", "mid")
    key = lambda df: {(r.image_id, r.span_no, r.beg, r.end) for r in df.collect()}
    got = key(spark.read.parquet(out))
    assert got == key(want) and len(got) == 6


def test_chunk_state_does_not_depend_on_the_order_of_arrival():
    rnd = random.Random(5)
    for _ in range(200):
        n = rnd.randint(1, 30)
        slices = [(64 + o, rnd.randint(0, 1), rnd.randint(0, 99)) for o in rnd.sample(range(64), n)]
        whole = fold_chunk(None, 64, 64, *(np.array(c) for c in zip(*slices)))
        rnd.shuffle(slices)
        known, at = None, 0
        while at < n:
            step = rnd.randint(1, 5)
            known, at = fold_chunk(known, 64, 64, *(np.array(c) for c in zip(*slices[at:at + step]))), at + step
        assert known == whole
        # A landing that comes twice changes nothing; a corrected label does.
        assert fold_chunk(known, 64, 64, *(np.array(c) for c in zip(*slices[:3]))) == whole
        o, label, pos = slices[0]
        turned = [(o, 1 - label, pos), *slices[1:]]
        assert fold_chunk(known, 64, 64, np.array([o]), np.array([1 - label]), np.array([pos])) == fold_chunk(
            None, 64, 64, *(np.array(c) for c in zip(*turned)))


@pytest.mark.parametrize("bits", [2, 12])
def test_lines_that_land_in_parts_and_late(spark, tmp_path, bits):
    rnd = random.Random(bits)
    land, out = str(tmp_path / "land"), str(tmp_path / "out")
    slices = [(i, s * 3 if i == 1 else s, rnd.randint(0, 2) % 2, s * 4 + 7) for i in (1, 2, None) for s in range(60)]
    slices += [(4, s, 0, s * 4 + 7) for s in range(9)]  # No separator at all.
    rnd.shuffle(slices)
    schema = "img int, slice_no bigint, label int, mid bigint"
    for turn, part in enumerate([slices[:50], slices[50:120], slices[100:170], slices[170:]]):
        spark.createDataFrame(part, schema).repartition(2).write.mode("append").parquet(land)
        stream = read_landing(spark, land, spark.createDataFrame([], schema).schema, max_files=1 if turn % 2 else None)
        track_runs(stream, "img", "slice_no", "label", "mid", out, str(tmp_path / "state"), bits=bits).awaitTermination()
        landed = spark.read.parquet(land).distinct()
        assert as_set(current_spans(spark, out, "img")) == as_set(char_spans(landed, "img", "slice_no", "label", "mid"))
    # A line of many chunks that is cut in the view, too.
    assert as_set(current_spans(spark, out, "img", bits=3, hot_rows=5).where("img IS NOT NULL")) == as_set(
        char_spans(landed.where("img IS NOT NULL"), "img", "slice_no", "label", "mid"))


def test_slices_without_a_place_and_empty_landings(spark, tmp_path):
    land, out = str(tmp_path / "land"), str(tmp_path / "out")
    schema = "img int, slice_no bigint, label int, mid bigint"
    for part in ([], [(1, None, 0, 3), (1, 4, None, 3), (1, 1, 0, None), (1, 2, 1, 9)], []):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(land)
        stream = read_landing(spark, land, spark.createDataFrame([], schema).schema)
        track_runs(stream, "img", "slice_no", "label", "mid", out, str(tmp_path / "state")).awaitTermination()
    assert as_set(current_spans(spark, out, "img")) == {(1, 0, 0, 9)}


def test_many_short_lines_share_few_state_keys(spark, tmp_path):
    land, out = str(tmp_path / "land"), str(tmp_path / "out")
    schema = "name string, day timestamp, img bigint, slice_no bigint, label int, mid bigint"
    names = [None, "", 'a"b\\\n', "é"]
    lines = [(names[i % 4], datetime(1900, 1, 1, 0, 0, 0, i), None if i % 3 else (1 << 60) + i) for i in range(60)]
    slices = [(*line, s << 4, s % 2, s) for line in lines for s in range(3)]
    for half in (slices[::2], slices[1::2]):
        spark.createDataFrame(half, schema).repartition(2).write.mode("append").parquet(land)
        stream = read_landing(spark, land, spark.createDataFrame([], schema).schema)
        job = track_runs(stream, ["name", "day", "img"], "slice_no", "label", "mid", out, str(tmp_path / "state"), bits=4, buckets=4)
        job.awaitTermination()
        # 180 chunks of one slice each: a call and a state row for each of them is what took the time.
        assert max(p["stateOperators"][0]["numRowsTotal"] for p in job.recentProgress) <= 4
    part = ["name", "day", "img"]
    key = lambda df: sorted(map(repr, df.select(*part, "span_no", "beg", "end").collect()))
    got = key(current_spans(spark, out, part))
    assert got == key(char_spans(spark.read.parquet(land), part, "slice_no", "label", "mid")) and len(got) >= 60
