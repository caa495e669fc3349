"""From label rows to labelled slices, with the checks on the way."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandcut.functions import names, notation
from strandcut.operators.ordering import as_list, hot_parts, ordered_index, prefix_sums, running_position


def clean_label_lines(df: DataFrame, raw: str, out: str = "spec") -> DataFrame:
    """Strip each row and leave out the empty ones."""
    return df.withColumn(out, notation.strip_row(F.col(raw))).where(F.col(out) != "")


def label_errors(df: DataFrame, spec: str) -> DataFrame:
    """The malformed rows, with the broken rule in ``error``: the quarantine table."""
    bad = df.where(~notation.well_formed(F.col(spec)))
    return bad.withColumn("error", notation.label_error(F.col(spec)))


def expand_labels(df: DataFrame, spec: str, *, strict: bool = True) -> DataFrame:
    """One row per named index with ``idx`` and ``import_flag``.

    The first malformed row fails the job; without ``strict`` such rows are
    left to :func:`label_errors`.
    """
    good = notation.well_formed(F.col(spec))
    if strict:
        fail = F.raise_error(F.concat(F.lit("bad label row: "), F.col(spec)))
        good = F.when(good, F.lit(True)).otherwise(fail.cast("boolean"))
    # The numbers are read once per row, in a column of their own; a long range
    # is exploded in two steps.
    read = df.where(good).withColumn("__nums", notation.numbers(F.col(spec)))
    blocks = read.select(
        *df.columns,
        notation.label_flag(F.col(spec)).alias("import_flag"),
        F.explode(notation.label_blocks(F.col(spec), F.col("__nums"))).alias("__block"),
    )
    return blocks.select(
        *df.columns, F.explode(F.sequence("__block.low", "__block.high")).alias("idx"), "import_flag"
    )


def specs_out_of_range(specs: DataFrame, counts: DataFrame, part: str | Sequence[str], spec: str, n: str) -> DataFrame:
    """Rows that name an index at or beyond their directory's slice count."""
    _, high = notation.label_bounds(F.col(spec))
    return specs.join(counts, as_list(part), "left").where(high >= F.coalesce(F.col(n), F.lit(0)))


def label_out_of_range(labels: DataFrame, counts: DataFrame, part: str | Sequence[str], idx: str, n: str) -> DataFrame:
    """Labels without a slice, given the number ``n`` of slices per directory.

    Slice numbers are dense, so the count alone decides and no slice is read.
    """
    joined = labels.join(counts, as_list(part), "left")
    return joined.where(F.col(idx) >= F.coalesce(F.col(n), F.lit(0))).select(*labels.columns)


def last_flags(labels: DataFrame, keys: Sequence[str], line: str = "line_at", flag: str = "import_flag") -> DataFrame:
    """One row per labelled slice; the last row, by ``line``, that names it sets the flag."""
    return labels.groupBy(*keys).agg(F.max_by(flag, line).alias(flag))


def apply_labels(
    slices: DataFrame, labels: DataFrame, keys: str | Sequence[str], *, flag: str = "import_flag"
) -> DataFrame:
    """Mark the labelled slices: type 1 and the label's flag; all others 0 and false.

    ``labels`` holds at most one row per key (see :func:`last_flags`).
    """
    keys = as_list(keys)
    marked = labels.select(*keys, F.col(flag).alias("__flag"), F.lit(1).alias("__hit"))
    return slices.join(marked, keys, "left").select(
        *slices.columns,
        F.coalesce("__hit", F.lit(0)).alias("image_type"),
        F.coalesce("__flag", F.lit(False)).alias("import_flag"),
    )


def missing_labels(items: DataFrame, labels: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Directories (or items) that no label file covers."""
    return items.join(labels.select(*as_list(key)), as_list(key), "left_anti")


def dense_index_violations(df: DataFrame, part: str | Sequence[str], idx: str) -> DataFrame:
    """Where the n-th item of a directory, in index order, does not carry index n.

    One row per ``(part, idx)`` with ``n_rows`` items and ``n_bad`` of them out
    of place. Equal indexes are counted before the shuffle; with P items below
    index v and c items at v, item number v lies among them or none is right.
    """
    part = as_list(part)
    counted = df.groupBy(*part, idx).agg(F.count(F.lit(1)).alias("n_rows"))
    # Indexes count the files of a directory, so two levels are plenty.
    hot = hot_parts(df, part)
    placed = prefix_sums(counted, part, idx, {"__below": F.col("n_rows")}, levels=2, hot=hot)
    hit = (F.col("__below") <= F.col(idx)) & (F.col(idx) < F.col("__below") + F.col("n_rows"))
    return placed.select(*part, idx, "n_rows", (F.col("n_rows") - hit.cast("bigint")).alias("n_bad")).where(
        F.col("n_bad") > 0
    )


def file_index_violations(files: DataFrame, directory: str, path: str) -> DataFrame:
    """Slice files whose place in path order differs from the index in their name.

    A name that does not parse is a violation too.
    """
    ordered = ordered_index(files, [directory, path], "__g")
    placed = running_position(ordered, directory, "__g", "place")
    idx = names.parse_number_pair(names.base_name(F.col(path)))["idx"]
    return placed.withColumn("idx", idx).where(~F.coalesce(F.col("idx") == F.col("place"), F.lit(False))).drop("__g")


def collect_all(tables: Sequence[DataFrame]) -> DataFrame:
    """All directories' labelled slices in one table."""
    return reduce(lambda a, b: a.unionByName(b), tables)
