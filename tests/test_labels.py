import itertools
import os

import pytest
from pyspark.sql import functions as F

import brute
from strandcut.functions import names, notation
from strandcut.operators import labelling
from strandcut.plans import prepare
from strandcut.sources import labels as label_files

# A folder of human label files, one labels.txt per directory; see FIXTURES.md.
FIXTURES = os.environ.get("STRANDCUT_LABEL_FIXTURES", "")


def test_notation_agrees_with_a_plain_reader_on_all_short_strings(spark):
    specs = ["".join(s) for n in range(1, 6) for s in itertools.product("35*+- ", repeat=n)]
    df = spark.createDataFrame([(s,) for s in specs], "spec string").repartition(8)
    got = df.select(
        "spec",
        notation.label_error(F.col("spec")).alias("error"),
        F.when(notation.label_error(F.col("spec")).isNull(), notation.expand_label_spec(F.col("spec"))).alias("idx"),
        F.when(notation.label_error(F.col("spec")).isNull(), notation.label_blocks(F.col("spec"))).alias("blocks"),
        notation.well_formed(F.col("spec")).alias("good"),
        notation.label_flag(F.col("spec")).alias("flag"),
        notation.label_bounds(F.col("spec"))[0].alias("low"),
        notation.label_bounds(F.col("spec"))[1].alias("high"),
    ).collect()
    assert len(got) == len(specs)
    for r in got:
        want = brute.expand(r.spec)
        assert (r.error is None) == r.good == (want is not None), r
        if want:
            assert (r.idx, r.flag) == (want[0], want[1]), r
            assert [i for b in r.blocks for i in range(b.low, b.high + 1)] == want[0], r
            assert (r.low, r.high) == (min(want[0]), max(want[0])), r


def test_long_ranges_are_exploded_in_blocks(spark):
    df = spark.createDataFrame([("7-200006*",), ("100000+70000",), ("9-3",), ("12*34",)], "spec string")
    got = labelling.expand_labels(df, "spec")
    rows = {r.spec: (r.n, r.low, r.high, r.d) for r in got.groupBy("spec").agg(
        F.count("*").alias("n"), F.min("idx").alias("low"), F.max("idx").alias("high"),
        F.count_distinct("idx").alias("d")).collect()}
    assert rows == {"7-200006*": (200000, 7, 200006, 200000), "100000+70000": (70001, 100000, 170000, 70001),
                    "9-3": (2, 3, 9, 2), "12*34": (2, 12, 34, 2)}


@pytest.mark.parametrize(
    "spec,error",
    [("*", "no_number"), ("35*+", "symbol_order"), ("35*-40", "symbol_order"), ("3++4", "double_plus"),
     ("1-2-3", "symbol_order"), ("1+2+3", "too_many_numbers"), ("5 6", "character"), ("35 ", "character"),
     ("a", "character"), ("1-", "range_needs_two"), ("9" * 25, "number_too_long")],
)
def test_error_names(spark, spec, error):
    df = spark.createDataFrame([(spec,)], "spec string")
    assert [r.error for r in labelling.label_errors(df, "spec").collect()] == [error]
    with pytest.raises(Exception, match="bad label row"):
        labelling.expand_labels(df, "spec", strict=True).collect()


def test_malformed_rows_fail_by_default(spark):
    df = spark.createDataFrame([("5",), ("35*+",)], "spec string")
    with pytest.raises(Exception, match="bad label row"):
        labelling.expand_labels(df, "spec").collect()
    assert [r.idx for r in labelling.expand_labels(df, "spec", strict=False).collect()] == [5]


def test_cleaning(spark):
    df = spark.createDataFrame([("\t5\t",), ("",), ("\t",), (" ",), ("7\n",)], "raw string")
    assert [r.spec for r in labelling.clean_label_lines(df, "raw").collect()] == ["5", " ", "7"]


def test_last_row_sets_the_flag_and_the_rest_is_zero(spark):
    slices = spark.createDataFrame([("d", i) for i in range(5)], "dir string, idx bigint")
    rows = spark.createDataFrame([("d", 0, "1+*"), ("d", 1, "2"), ("d", 2, "4*")], "dir string, line_no int, spec string")
    flags = labelling.last_flags(labelling.expand_labels(rows, "spec"), ["dir", "idx"], "line_no")
    got = {r.idx: (r.image_type, r.import_flag) for r in labelling.apply_labels(slices, flags, ["dir", "idx"]).collect()}
    assert got == {0: (0, False), 1: (1, True), 2: (1, False), 3: (0, False), 4: (1, True)}


def test_range_and_presence_checks(spark):
    counts = spark.createDataFrame([("a", 5)], "dir string, n bigint")
    specs = spark.createDataFrame([("a", "3+"), ("a", "3++"), ("a", "9-2"), ("b", "0")], "dir string, spec string")
    bad = labelling.specs_out_of_range(specs, counts, "dir", "spec", "n").collect()
    assert {(r.dir, r.spec) for r in bad} == {("a", "3++"), ("a", "9-2"), ("b", "0")}
    marks = spark.createDataFrame([("a", 4), ("a", 5), ("c", 0)], "dir string, idx bigint")
    assert {tuple(r) for r in labelling.label_out_of_range(marks, counts, "dir", "idx", "n").collect()} == {("a", 5), ("c", 0)}
    assert [r.dir for r in labelling.missing_labels(marks.select("dir").distinct(), counts, "dir").collect()] == ["c"]


def test_dense_index(spark):
    rows = [("ok", i) for i in range(6)] + [("twice", i) for i in (0, 1, 1, 2)] + [("gap", i) for i in (0, 2, 3)]
    df = spark.createDataFrame(rows, "dir string, idx bigint")
    got = {(r.dir, r.idx): (r.n_rows, r.n_bad) for r in labelling.dense_index_violations(df, "dir", "idx").collect()}
    assert got == {("twice", 1): (2, 1), ("twice", 2): (1, 1), ("gap", 2): (1, 1), ("gap", 3): (1, 1)}


def test_file_index_follows_path_order(spark):
    paths = [f"/r/d/word_seg_{i:04d}_type_00.png" for i in (0, 1, 3)] + ["/r/e/word.png", "/r/e/word_seg_0001_type_01.png"]
    df = spark.createDataFrame([(p.split("/")[2], p) for p in paths], "dir string, path string")
    bad = labelling.file_index_violations(df, "dir", "path").collect()
    # word.png sorts before word_seg_0001, which so is rightly number 1.
    assert {r.path for r in bad} == {paths[2], paths[3]}


def test_names(spark):
    df = spark.createDataFrame(
        [("a.tar.gz",), (".hidden",), ("plain",), ("a..b",), ("x.png",)], "n string"
    )
    parts = names.split_ext(F.col("n"))
    got = {r.n: (r.s, r.e) for r in df.select("n", parts["stem"].alias("s"), parts["ext"].alias("e")).collect()}
    assert got == {n: os.path.splitext(n) for n in got}


def test_files_as_rows(spark, tmp_path):
    from strandcut.sources.files import scan_files
    from strandcut.sources.images import scan_slice_files

    root = tmp_path / "a root+%20"
    for place, text in (("a/x", "1\n2\n"), ("b/x", ""), ("a b+c/x", "3\n"), ("c", None), ("", "9\n")):
        (root / place).mkdir(parents=True, exist_ok=True)
        (root / place / "word_seg_0000_type_00.png").write_bytes(b"" if place == "c" else b"x")
        if text is not None:
            (root / place / "labels.txt").write_text(text)
    for listings in (1, 2, 50):
        found = scan_files(spark, str(root), listings=listings).collect()
        assert sorted((r.dir, r.name, r.length) for r in found if r.name == "labels.txt") == [
            ("", "labels.txt", 2), ("a b+c/x", "labels.txt", 2), ("a/x", "labels.txt", 4), ("b/x", "labels.txt", 0)]
        assert len(found) == 9 and all(os.path.getsize(r.path) == r.length for r in found)
    files = scan_slice_files(spark, str(root) + "/")
    assert sorted(r.dir for r in files.collect()) == ["", "a b+c/x", "a/x", "b/x", "c"]
    lines = label_files.scan_label_lines(spark, str(root))
    assert sorted(((r.dir, r.raw) for r in lines.collect()), key=repr) == [
        ("", "9"), ("a b+c/x", "3"), ("a/x", "1"), ("a/x", "2"), ("b/x", None)]
    # An empty file is there and labels nothing; a directory without one is a problem.
    labelled = prepare.labelled_slices(files, lines.where("dir = 'b/x'"))
    assert {r.image_type for r in labelled.collect()} == {0}
    missing = prepare.label_problems(files, lines).where("problem = 'no_label_file'")
    assert [r.dir for r in missing.collect()] == ["c"]
    assert label_files.scan_predicted(spark, str(root), "labels.txt").count() == 4
    assert scan_files(spark, str(root / "c"), "*.txt").count() == 0


def test_label_file_split_over_tasks_keeps_its_order(spark, tmp_path):
    (tmp_path / "big").mkdir()
    # Every index is named twice; the later row drops the flag of odd ones.
    text = "".join(f"{i}*\n" for i in range(3000)) + "".join(f"{i}{'*' if i % 2 == 0 else ''}\n" for i in range(3000))
    (tmp_path / "big" / "labels.txt").write_text(text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = label_files.scan_label_lines(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 5
        flags = labelling.last_flags(labelling.expand_labels(rows, "raw"), ["dir", "idx"]).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(flags) == 3000 and all(r.import_flag == (r.idx % 2 == 0) for r in flags)


@pytest.mark.skipif(not os.path.isdir(FIXTURES), reason="label fixtures are absent")
def test_label_fixtures(spark):
    rows = label_files.scan_label_lines(spark, FIXTURES)
    specs = labelling.clean_label_lines(rows, "raw")
    assert specs.count() == 3183 and labelling.label_errors(specs, "spec").count() == 0
    expanded = labelling.expand_labels(specs, "spec", strict=True)
    last = labelling.last_flags(expanded, ["dir", "idx"])
    got = last.agg(F.count("*").alias("n"), F.count_if("import_flag").alias("f"), F.max("idx").alias("m"),
                   F.count_distinct("dir").alias("d")).first()
    assert tuple(got) == (3692, 145, 1109, 64)
    assert expanded.groupBy("dir", "idx").count().where("count > 1").count() == 2
    assert label_files.scan_predicted(spark, FIXTURES).count() == 20


def test_files_to_training_sets(spark, tmp_path):
    for d, n, text in (("one", 50, "3\n7+*\n"), ("two", 60, "\t10-12\t\n\n5*")):
        (tmp_path / d).mkdir()
        for i in range(n):
            (tmp_path / d / f"word_seg_{i:04d}_type_00.png").write_bytes(b"x")
        (tmp_path / d / "labels.txt").write_text(text)
    from strandcut.sources.images import scan_slice_files

    files = scan_slice_files(spark, str(tmp_path))
    labelled = prepare.labelled_slices(files, label_files.scan_label_lines(spark, str(tmp_path)))
    got = {(r.dir, r.idx): r.import_flag for r in labelled.where("image_type = 1").collect()}
    assert got == {("one", 3): False, ("one", 7): True, ("one", 8): True, ("two", 5): True,
                   ("two", 10): False, ("two", 11): False, ("two", 12): False}
    assert labelled.count() == 110
    lines = label_files.scan_label_lines(spark, str(tmp_path))
    assert prepare.label_problems(files, lines).count() == 0
    more = spark.createDataFrame([("one", 9, "49+"), ("two", 9, "1-2-3"), ("three", 0, "0")], "dir string, line_no int, raw string")
    extra = spark.createDataFrame([("four", "/r/four/word_seg_0001_type_00.png", 1)], "dir string, path string, length bigint")
    found = prepare.label_problems(files.unionByName(extra), lines.drop("line_at").unionByName(more.drop("line_no"))).collect()
    assert {(r.dir, r.problem) for r in found} == {
        ("one", "out_of_range"), ("two", "symbol_order"), ("three", "out_of_range"), ("four", "file_index"), ("four", "no_label_file")}
    sets = prepare.slice_sets(labelled, fraction=0.3, seed=1, times=3)
    assert sets.count() == 110 + 3 * 2
    assert sets.where("is_test and copy_no = 0").count() == 33
    seqs = prepare.sequence_sets(labelled, fraction=0.5, seed=1, size=20, step=10)
    assert seqs.count() == 9 and seqs.where("is_test").count() == 5
    first = seqs.where("window_id = 4").first()["items"]
    assert [x.path.split("/")[-2] for x in first] == ["one"] * 10 + ["two"] * 10
