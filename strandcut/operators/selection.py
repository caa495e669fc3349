"""Where a row stands in the order of a table, found by counting instead of sorting.

The table is counted by ranges between a few pivots, the range that holds the
wanted place is counted again, and so on; each round is one scan whose counts are
combined before their shuffle, and leaves a small part of the rows. Only the last
range is sorted.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from strandcut.operators.ordering import as_list, hash_key, ordered_index

#: Pivots of a round; a power of two less one. Ranges of up to so many rows are sorted in one task.
PIVOTS, SMALL = 255, 1 << 16
#: Hash digits that are counted in a round.
DIGITS = 3


def _literal(value, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        return F.struct(*[_literal(v, f.dataType).alias(f.name) for v, f in zip(value, kind)])
    return F.lit(value).cast(kind)


def _below(pivots: list[Row], kind: T.StructType, key: str) -> Column:
    """How many pivots a key has reached, by binary search in a constant array."""
    sorted_pivots = F.array(*[_literal(p, kind) for p in pivots])
    steps, step = [], 1
    while step <= len(pivots):
        steps, step = [step, *steps], step * 2
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]), F.lit(0),
        lambda at, s: F.when(
            (at + s <= len(pivots)) & (F.get(sorted_pivots, F.least(at + s, F.lit(len(pivots))) - 1) <= F.col(key)), at + s
        ).otherwise(at),
    )


def place_range(
    df: DataFrame, order: Sequence[str], first: int, n: int, *, pivots: int = PIVOTS, small: int = SMALL
) -> tuple[DataFrame, int, int]:
    """Some rows that hold places ``first`` to ``first + n - 1``, how many come before them, and how many they are.

    Added is ``__key``, by which they are to be sorted: the ``order``, nulls
    first, and a hash of the whole row, so only rows equal in all columns are
    interchangeable. Rounds end when at most ``n + small`` rows are left, or equal ones only.
    """
    names = as_list(order)
    keyed = df.withColumn("__key", F.struct(*[F.col(c) for c in names], F.xxhash64(*df.columns).alias("__tie")))
    kind = keyed.schema["__key"].dataType
    part, before, rows = keyed, 0, df.count()
    while rows > n + small:
        some = part.select("__key").orderBy(F.rand()).limit(pivots).distinct().orderBy("__key").collect()
        bounds = [r["__key"] for r in some]
        counts = dict(part.groupBy(_below(bounds, kind, "__key").alias("range")).agg(F.count(F.lit(1))).collect())
        upto = list(accumulate((counts.get(i, 0) for i in range(len(bounds) + 1)), initial=0))
        low = max(i for i in range(len(bounds) + 1) if before + upto[i] <= first)
        high = min((i for i in range(low + 1, len(bounds) + 2) if before + upto[i] >= first + n), default=len(bounds) + 1)
        if upto[high] - upto[low] == rows:
            break
        if low:
            part = _from(part, names[0], bounds[low - 1], kind, True)
        if high <= len(bounds):
            part = _from(part, names[0], bounds[high - 1], kind, False)
        before, rows = before + upto[low], upto[high] - upto[low]
    return part, before, rows


def _from(part: DataFrame, name: str, bound: Row, kind: T.StructType, up: bool) -> DataFrame:
    """Rows on one side of a pivot; its first component alone can be pushed to the files."""
    whole = F.col("__key") >= _literal(bound, kind) if up else F.col("__key") < _literal(bound, kind)
    if bound[0] is None:
        return part.where(whole if up else whole & F.col(name).isNull())
    lone = _literal(bound[0], kind[0].dataType)
    return part.where((F.col(name) >= lone if up else F.col(name).isNull() | (F.col(name) <= lone)) & whole)


def rows_at(df: DataFrame, order: Sequence[str], first: int, n: int = 1, **options: int) -> DataFrame:
    """Rows number ``first`` to ``first + n - 1`` in ``order`` (nulls first), with ``idx``.

    The range that holds them is found by counting. Many rows are numbered as
    :func:`ordered_index` does it, that range alone.
    """
    part, before, rows = place_range(df, order, first, n, **options)
    small = options.get("small", SMALL)
    idx = F.col("idx").cast("bigint")
    if rows > 2 * small and n > small:
        numbered = ordered_index(part, ["__key"], "idx").withColumn("idx", idx + before)
        return numbered.where((F.col("idx") >= first) & (F.col("idx") < first + n)).drop("__key")
    # The first of the range, in one task, are no more than the range or than what is asked for.
    some = part.orderBy("__key").offset(first - before).limit(n)
    number = F.row_number().over(Window.orderBy("__key")) + (first - 1)
    return some.withColumn("idx", number.cast("bigint")).drop("__key")


def hash_quota(df: DataFrame, ids: str | Sequence[str], seed: int, fraction: float, *, digits: int = DIGITS, small: int = SMALL) -> Column:
    """Whether a row is among the first ``ceil(fraction * n)`` by the hash of its unique id, as an expression.

    The leading hash digits are counted, then the next ones below the digits in
    which the quota ends, and so on; hashes spread evenly, so each round leaves a
    4,096th of the rows. What remains is a comparison with one key.
    """
    ids = as_list(ids)
    key = hash_key(seed, *ids)
    part, prefix, below, quota = df.select(key.alias("__hash"), *ids), "", 0, None
    while True:
        head = F.substring("__hash", len(prefix) + 1, digits)
        counts = sorted(part.groupBy(head.alias("head")).agg(F.count(F.lit(1)).alias("n")).collect())
        if quota is None:
            quota = math.ceil(round(sum(c for _, c in counts) * fraction, 6))
            if quota <= 0 or not counts:
                return F.lit(False)
        for at, c in counts:
            if below + c >= quota:
                break
            below += c
        prefix += at
        if below + c == quota:
            return F.substring(key, 1, len(prefix)) <= F.lit(prefix)
        part = part.where(F.col("__hash").startswith(prefix))
        if c <= small or len(prefix) + digits > 32:
            break
    last = part.orderBy("__hash", *ids).offset(quota - below - 1).limit(1)
    kind = last.schema
    return F.struct(key, *[F.col(i) for i in ids]) <= _literal(last.first(), kind)
