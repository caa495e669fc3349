"""Ordered running values that never put one large group into one task.

A plain ``Window.partitionBy(dir).orderBy(idx)`` sorts a whole directory in
one task, and an unpartitioned window sorts the whole table in one. Here large
groups are cut into chunks of the order first. Because the order column is an
integer that is unique within its partition, a chunk of ``2**bits`` consecutive
values holds at most ``2**bits`` rows, however hot the partition is. The running
value is taken inside each chunk; one small row per chunk carries what the
chunks before it add up to, and is joined back on the same keys, so the data is
shuffled once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window, WindowSpec

from strandcut.session import shared_dir

CHUNK_BITS = 16
CARRY_BITS = 24
LEVELS = 3
HOT_ROWS = 1 << 20
# Keys of large partitions that may be sent to all tasks.
HOT_LISTED = 1 << 14
HASH_BITS = 60
CHUNK_ROWS = 1 << 16


def as_list(cols: str | Sequence[str] | None) -> list[str]:
    if cols is None:
        return []
    return [cols] if isinstance(cols, str) else list(cols)


def chunk_of(order: str | Column, bits: int = CHUNK_BITS) -> Column:
    col = F.col(order) if isinstance(order, str) else order
    return F.shiftright(col.cast("bigint"), bits)


@dataclass(frozen=True)
class HotParts:
    """The large partitions of a table: their keys, marked by ``__hot``, and whether one of them is null."""

    keys: DataFrame
    part: tuple[str, ...]
    nulls: bool

    def mark(self, df: DataFrame) -> DataFrame:
        return join_parts(df, self.keys, list(self.part), nulls=self.nulls)


def join_parts(df: DataFrame, other: DataFrame, keys: Sequence[str], how: str = "left", *, nulls: bool = True) -> DataFrame:
    """Join on ``keys``; with ``nulls``, null keys meet null ones."""
    if not nulls:
        return df.join(other, list(keys), how)
    renamed = other.withColumnsRenamed({k: f"__of_{k}" for k in keys})
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys])
    return df.join(renamed, same, how).drop(*[f"__of_{k}" for k in keys])


def hot_parts(df: DataFrame, part: Sequence[str], hot_rows: int = HOT_ROWS) -> HotParts | None:
    """The partitions of more than ``hot_rows`` rows; None without any.

    There are at most ``rows / hot_rows`` of them, found by counting, which is
    combined before its shuffle. Up to ``HOT_LISTED`` are sent to all tasks; more are
    an ordinary table to join with.
    """
    sizes = df.groupBy(*part).agg(F.count(F.lit(1)).alias("__rows")).where(F.col("__rows") > hot_rows)
    hot = sizes.select(*part, F.lit(True).alias("__hot"))
    found = hot.count()
    if not found:
        return None
    if found <= HOT_LISTED:
        some = hot.collect()
        keys = F.broadcast(df.sparkSession.createDataFrame(some, hot.schema))
        return HotParts(keys, tuple(part), any(None in r for r in some))
    return HotParts(hot, tuple(part), True)


#: Scans along an order: how rows are put together, and what a row takes from those before it. ``near`` is the
#: nearest value that is not null, ``far`` the one at the end.
FOLDS = {
    "sum": (F.sum, lambda local, carry: F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0))),
    "min": (F.min, lambda local, carry: F.least(local, carry)),
    "max": (F.max, lambda local, carry: F.greatest(local, carry)),
    "near": (lambda v: F.last(v, ignorenulls=True), lambda local, carry: F.coalesce(local, carry)),
    "far": (lambda v: F.first(v, ignorenulls=True), lambda local, carry: F.coalesce(carry, local)),
}


def scan(
    df: DataFrame, part: str | Sequence[str] | None, order: str, before: Mapping[str, tuple[str, Column]],
    after: Mapping[str, tuple[str, Column]] | None = None, *, bits: int = CARRY_BITS, levels: int = LEVELS,
) -> DataFrame:
    """Add what the rows ``before`` each row, and those ``after`` it, come to along ``order`` within ``part``.

    Each entry is ``name: (fold, value)`` with a fold of ``FOLDS``. ``order`` is an
    integer, unique within ``part``. It is cut every ``2**bits`` values: the chunks
    are folded up into one row each, which is scanned the same way, level
    by level, and each chunk adds what it is handed to what its own rows come to. No window
    holds more than ``2**bits`` rows below the last of the ``levels``. Null parts are parts like others.
    """
    part, after = as_list(part), dict(after or {})
    columns = df.columns
    both = {**{n: (*v, False) for n, v in before.items()}, **{n: (*v, True) for n, v in after.items()}}
    chunk = f"__scan{levels}"
    tagged = df.withColumns({f"__v_{n}": v for n, (_, v, _) in both.items()})
    if levels > 1:
        tagged = tagged.withColumn(chunk, chunk_of(order, bits))
    keys = [*part, chunk] if levels > 1 else part
    along = Window.partitionBy(*keys).orderBy(F.col(order)).rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy(*keys).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, -1)
    local = tagged.withColumns({f"__l_{n}": FOLDS[fold][0](f"__v_{n}").over(back if later else along) for n, (fold, _, later) in both.items()})
    if levels == 1:
        return local.select(*columns, *[FOLDS[f][1](F.col(f"__l_{n}"), F.lit(None)).alias(n) for n, (f, _, _) in both.items()])

    def whole(n: str, fold: str, later: bool) -> Column:
        if fold in ("near", "far"):
            place = F.when(F.col(f"__v_{n}").isNotNull(), F.col(order))
            return (F.max_by if (fold == "near") != later else F.min_by)(f"__v_{n}", place)
        return FOLDS[fold][0](f"__v_{n}")

    chunks = tagged.groupBy(*keys).agg(*[whole(n, f, later).alias(f"__w_{n}") for n, (f, _, later) in both.items()])
    handed = scan(
        chunks, part, chunk, {f"__c_{n}": (f, F.col(f"__w_{n}")) for n, (f, _, later) in both.items() if not later},
        {f"__c_{n}": (f, F.col(f"__w_{n}")) for n, (f, _, later) in both.items() if later}, bits=bits, levels=levels - 1,
    ).drop(*[f"__w_{n}" for n in both])
    joined = join_parts(local, handed, keys, "left")
    return joined.select(*columns, *[FOLDS[f][1](F.col(f"__l_{n}"), F.col(f"__c_{n}")).alias(n) for n, (f, _, _) in both.items()])


def prefix_sums(
    df: DataFrame,
    part: str | Sequence[str] | None,
    order: str | Sequence[str],
    sums: Mapping[str, Column],
    *,
    inclusive: bool = False,
    totals: bool = False,
    chunk: Sequence[Column] | None = None,
    bits: int = CHUNK_BITS,
    carry_bits: int = CARRY_BITS,
    levels: int = LEVELS,
    hot_rows: int | None = HOT_ROWS,
    hot: HotParts | None | str = "count",
) -> DataFrame:
    """Add running sums of ``sums`` over ``order`` within ``part``.

    ``chunk`` lists expressions that never decrease along ``order``; by default
    the single integer ``order`` column is cut every ``2**bits`` values. With
    ``totals`` each sum also gets a ``<name>_total`` column over the whole
    partition.

    Only partitions of more than ``hot_rows`` rows are cut; the others are one
    chunk and need no carry (None cuts all). ``hot`` gives the result of
    :func:`hot_parts` where counting ``df`` itself would be dear. Null parts are parts like others.

    The chunk rows are summed up the same way, ``levels`` deep: integers
    ``carry_bits`` at a time, lists of expressions one expression at a time. By
    default an ordered group has at most ``2**16`` data rows or ``2**24`` narrow
    chunk rows, for any unique 64-bit key, dense or sparse.
    """
    part, order = as_list(part), as_list(order)
    columns = df.columns
    split = bool(part) and hot_rows is not None
    if split and hot == "count":
        hot = hot_parts(df, part, hot_rows)
    if split and hot is None:
        return _window_sums(df, part, order, sums, inclusive, totals)
    nulls = hot.nulls if split else True
    if not part and chunk is None and levels == LEVELS:
        # The values' range tells how many levels there are.
        low, high = df.agg(F.min(order[0]).cast("bigint"), F.max(order[0]).cast("bigint")).first()
        if low is None or (high >> bits) - (low >> bits) < 1 << carry_bits:
            levels = 2
    cuts = list(chunk) if chunk is not None else [chunk_of(order[0], bits)]
    if split:
        df = hot.mark(df)
        cuts = [F.when(F.col("__hot"), c) for c in cuts]
    cut_names = [f"__cut{levels}_{i}" for i in range(len(cuts))]
    tagged = df.withColumns(dict(zip(cut_names, cuts))).withColumns(
        {f"__in_{name}": expr for name, expr in sums.items()}
    )
    keys = part + cut_names

    chunked = tagged.where("__hot") if split else tagged
    carried = chunked.groupBy(*keys).agg(*[F.sum(f"__in_{n}").alias(f"__sum_{n}") for n in sums])
    whole = isinstance(carried.schema[cut_names[0]].dataType, T.IntegralType)
    if levels > 2 and (len(cuts) > 1 or whole):
        above = {f"__carry_{n}": F.col(f"__sum_{n}") for n in sums}
        coarser = {"chunk": [F.col(c) for c in cut_names[:-1]]} if len(cuts) > 1 else {"bits": carry_bits}
        carried = prefix_sums(
            carried, part, cut_names, above, totals=totals, carry_bits=carry_bits, levels=levels - 1, hot_rows=None, **coarser,
        ).drop(*[f"__sum_{n}" for n in sums])
        if totals:
            carried = carried.withColumnsRenamed({f"__carry_{n}_total": f"{n}_total" for n in sums})
    else:
        across = Window.partitionBy(*part).orderBy(*cut_names)
        earlier = across.rowsBetween(Window.unboundedPreceding, -1)
        carry_cols = [
            F.coalesce(F.sum(f"__sum_{n}").over(earlier), F.lit(0)).alias(f"__carry_{n}") for n in sums
        ]
        if totals:
            every = Window.partitionBy(*part)
            carry_cols += [F.sum(f"__sum_{n}").over(every).alias(f"{n}_total") for n in sums]
        carried = carried.select(*keys, *carry_cols)

    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1
    )
    local = tagged.withColumns(
        {f"__local_{n}": F.coalesce(F.sum(f"__in_{n}").over(inside), F.lit(0)) for n in sums}
    )
    if totals and split:
        # A partition that is not cut is one group of the keys.
        local = local.withColumns({f"__all_{n}": F.sum(f"__in_{n}").over(Window.partitionBy(*keys)) for n in sums})
    if part and nulls:
        joined = join_parts(local, carried, keys, "left")
        if split:
            joined = joined.withColumns({f"__carry_{n}": F.when(F.col("__hot"), F.col(f"__carry_{n}")) for n in sums})
    else:
        joined = local.join(carried, keys, "left")
    out = [F.col(c) for c in columns if c not in sums]
    out += [(F.col(f"__local_{n}") + F.coalesce(f"__carry_{n}", F.lit(0))).alias(n) for n in sums]
    if totals:
        out += [(F.coalesce(f"{n}_total", f"__all_{n}") if split else F.col(f"{n}_total")).alias(f"{n}_total") for n in sums]
    return joined.select(*out)


def _window_sums(
    df: DataFrame, part: list[str], order: list[str], sums: Mapping[str, Column], inclusive: bool, totals: bool
) -> DataFrame:
    """The sums where no partition is large: one window."""
    values = df.withColumns({f"__in_{n}": e for n, e in sums.items()})
    inside = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    every = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = [F.col(c) for c in df.columns if c not in sums]
    out += [F.coalesce(F.sum(f"__in_{n}").over(inside), F.lit(0)).alias(n) for n in sums]
    if totals:
        out += [F.sum(f"__in_{n}").over(every).alias(f"{n}_total") for n in sums]
    return values.select(*out)


def running_position(
    df: DataFrame,
    part: str | Sequence[str] | None,
    order: str | Sequence[str],
    name: str = "pos",
    **options,
) -> DataFrame:
    """Number rows 0, 1, 2 … along ``order`` within ``part``."""
    return prefix_sums(df, part, order, {name: F.lit(1).cast("bigint")}, **options)


def number_copies(
    df: DataFrame,
    part: str | Sequence[str],
    order: Sequence[str],
    name: str = "pos",
    *,
    hot_rows: int = HOT_ROWS,
    **options,
) -> DataFrame:
    """Number rows along ``order`` within ``part`` where equal rows may abound.

    Returns ``part``, ``order`` and the number. Copies are counted before the
    shuffle and written out again at the end, in blocks, so they are never
    ordered or held together.
    """
    part, order = as_list(part), as_list(order)
    counted = df.groupBy(*part, *order).agg(F.count(F.lit(1)).alias("__copies"))
    hot = hot_parts(df, part, hot_rows)
    placed = prefix_sums(counted, part, order, {"__first": F.col("__copies")}, hot=hot, **options)
    last = F.col("__copies") - 1
    block = 1 << CHUNK_BITS
    step = F.lit(block).cast("bigint")
    blocks = placed.withColumn("__from", F.explode(F.sequence(F.lit(0).cast("bigint"), last, step)))
    number = F.explode(F.sequence("__from", F.least(F.col("__from") + block - 1, last)))
    rows = blocks.select(*part, *order, "__first", number.alias("__copy"))
    return rows.select(*part, *order, (F.col("__first") + F.col("__copy")).alias(name))


def ordered_index(df: DataFrame, keys: Sequence[str], name: str = "idx") -> DataFrame:
    """Number all rows 0, 1, 2 … in the order of any sortable ``keys``.

    The rows are range-partitioned on the keys, so a run of equal leading keys
    is still spread by the later ones, and copies are spread by a row number.
    That number is given after sorting each task's rows by content, so a task
    that is run again gives equal rows equal numbers. The sorted rows are
    checkpointed to the shared folder, which fixes their place for good, and
    the count of each range partition (one row per partition) tells where it
    starts.
    """
    shared_dir(df.sparkSession)
    ties = "__tie"
    placed = (
        df.sortWithinPartitions(*keys, F.xxhash64(*df.columns))
        .withColumn(ties, F.monotonically_increasing_id())
        .repartitionByRange(*[F.col(k) for k in keys], F.col(ties))
        .sortWithinPartitions(*keys, ties)
        .drop(ties)
        .checkpoint(eager=True)
    )
    # Upper bits of the generated id are the partition, lower 33 the row in it.
    rowed = placed.withColumn("__row", F.monotonically_increasing_id())
    rowed = rowed.withColumns(
        {"__pid": F.shiftright("__row", 33), "__at": F.col("__row").bitwiseAND(F.lit((1 << 33) - 1))}
    )
    starts = rowed.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("__pid", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    # One row per range partition: as many as spark.sql.shuffle.partitions at most.
    return rowed.join(F.broadcast(starts), "__pid").select(
        *df.columns, (F.col("__start") + F.col("__at")).alias(name)
    )


def hash_key(seed: int, *ids: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(i).cast("string") for i in ids]))


def hash_position(
    df: DataFrame, ids: str | Sequence[str], seed: int, name: str = "pos", chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Place of each row in the order of the hash of its unique id.

    The leading ``HASH_BITS`` of the hash are an integer key that spreads rows evenly, so
    chunks of equally many values hold about ``chunk_rows`` each, however many rows there are.
    """
    ids = as_list(ids)
    head = F.conv(F.substring("__hash", 1, HASH_BITS // 4), 16, 10).cast("bigint")
    keyed = df.withColumn("__hash", hash_key(seed, *ids)).withColumn("__head", head)
    chunks = max(1, df.count() // chunk_rows)
    bits = HASH_BITS - (chunks - 1).bit_length()
    levels = 2 if chunks <= 1 << CARRY_BITS else LEVELS + 1
    return running_position(keyed, None, ["__head", "__hash", *ids], name, bits=bits, levels=levels).drop("__hash", "__head")


def with_neighbours(
    df: DataFrame, window: WindowSpec, cols: Sequence[str], k: int, fill: Column | None = None
) -> DataFrame:
    """Add ``<col>_prev1..k`` and ``<col>_next1..k`` along a window's order."""
    extra = {}
    for c in cols:
        for i in range(1, k + 1):
            for word, fn in (("prev", F.lag), ("next", F.lead)):
                value = fn(c, i).over(window)
                extra[f"{c}_{word}{i}"] = F.coalesce(value, fill) if fill is not None else value
    return df.withColumns(extra)


def neighbours(
    df: DataFrame,
    part: str | Sequence[str] | None,
    position: str,
    cols: Sequence[str],
    k: int,
    *,
    fill: Column | None = None,
    bits: int = CHUNK_BITS,
) -> DataFrame:
    """As :func:`with_neighbours`, along a dense ``position``, for groups of any size.

    Rows within ``k`` of a chunk border are sent to the adjoining chunk too,
    so each chunk sees its whole neighbourhood without a wider group.
    """
    part = as_list(part)
    if not 0 < k < (1 << bits):
        raise ValueError("k must be positive and smaller than a chunk")
    own = chunk_of(position, bits)
    homes = F.array_distinct(F.array(own, chunk_of(F.col(position) - k, bits), chunk_of(F.col(position) + k, bits)))
    spread = df.withColumn("__own", own).withColumn("__home", F.explode(homes))
    w = Window.partitionBy(*part, "__home").orderBy(position)
    seen = with_neighbours(spread, w, cols, k, fill)
    return seen.where(F.col("__own") == F.col("__home")).drop("__own", "__home")
