"""Two views of a slice, the key bank and contrastive logits.

Queries meet a bank block by block. Each pair of blocks is a matrix product
inside one task; only a few numbers for each query leave it, and these can be
added up over any cut of the bank. No bank is ever fetched or sent to all tasks,
so neither its length nor that of the queries is bounded.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from strandcut.functions.vectors import doubles, dot, flip, random_bit
from strandcut.operators.ordering import as_list, chunk_of, running_position

BANK_SIZE = 65_536
TEMPERATURE = 0.07
#: Keys and queries that one task multiplies, and the queries whose logits it holds at once.
KEY_ROWS, QUERY_ROWS, PART_ROWS = 8_192, 8_192, 256


def random_flip(df: DataFrame, key: str, vec: str, seed: int, *, p: float = 0.5, width: int | None = None) -> DataFrame:
    """Mirror each row's picture with probability ``p``, the same way on every run."""
    return df.withColumn(vec, flip(F.col(vec), random_bit(seed, F.col(key), p=p), width))


def two_views(df: DataFrame, key: str, vec: str, seed: int, *, width: int | None = None) -> DataFrame:
    """Two independently flipped views per row, numbered by ``view_no``."""
    views = df.withColumn("view_no", F.explode(F.array(F.lit(0), F.lit(1))))
    coin = random_bit(seed, F.col(key), F.col("view_no"))
    return views.withColumn(vec, flip(F.col(vec), coin, width))


def positive_logit(df: DataFrame, q: str, k: str, out: str = "l_pos") -> DataFrame:
    """Dot product of a row's two encodings."""
    return df.withColumn(out, dot(doubles(F.col(q)), doubles(F.col(k))))


def key_bank(df: DataFrame, seq: str, size: int = BANK_SIZE) -> DataFrame:
    """The newest ``size`` keys by arrival number, with their ring ``slot``.

    The slot is the arrival rank modulo ``size``, so gaps in the numbers leave
    no slot empty and give none to two keys.

    Arrival numbers are counted in blocks first. The newest keys lie in the
    newest blocks, so only rows of those are ordered, instead of ``size`` wide
    rows from every task.
    """
    blocks = counts = df.groupBy(chunk_of(seq).alias("__block")).agg(F.count(F.lit(1)).alias("__n"))
    # No block is empty: the newest ``size`` of them hold ``size`` keys or all.
    blocks = blocks.orderBy(F.desc("__block")).limit(size)
    newer = Window.orderBy(F.desc("__block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("__newer", F.coalesce(F.sum("__n").over(newer), F.lit(0)))
    oldest = blocks.where(F.col("__newer") < size).agg(F.min("__block"))
    recent = df.where(chunk_of(seq) >= oldest.scalar())
    total = counts.agg(F.coalesce(F.sum("__n"), F.lit(0))).scalar()
    newest = recent.orderBy(F.desc(seq)).limit(size)
    rank = total - F.row_number().over(Window.orderBy(F.desc(seq)))
    return newest.withColumn("slot", F.pmod(rank, F.lit(size)).cast("bigint"))


def bank_places(bank: DataFrame, vec: str, slot: str = "slot") -> DataFrame:
    """A bank's keys as ``place, vec``, by their slot in the ring."""
    return bank.select(F.col(slot).cast("bigint").alias("place"), doubles(F.col(vec)).alias("vec"))


def _met(queries: DataFrame, keys: list[str], bank: DataFrame, kernel, out: T.StructType, most: int, key_rows: int, query_rows: int) -> DataFrame:
    """``kernel`` over each block of queries and each block of the bank that one of them sees.

    ``queries`` has the ``keys``, ``q`` and the places ``[since, until)`` of the
    bank that it sees; at most ``most`` of them see one block. Both sides are cut, so no task holds
    more than ``key_rows`` keys and about ``query_rows`` queries.
    """
    cuts = max(1, -(-most // query_rows))
    first, last = F.floor(F.col("since") / key_rows), F.floor((F.col("until") - 1) / key_rows)
    cut_queries = queries.where("since < until").withColumn("__block", F.explode(F.sequence(first, last))).withColumn(
        "__cut", F.pmod(F.xxhash64(*keys), F.lit(cuts)).cast("int")
    )
    blocks = bank.withColumn("__block", F.floor(F.col("place") / key_rows)).withColumn(
        "__cut", F.explode(F.sequence(F.lit(0), F.lit(cuts - 1)))
    )

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({f.name: [] for f in out})
        right = right.sort_values("place")
        places, vecs = right["place"].to_numpy(), np.stack(right["vec"].to_list())
        parts = []
        for at in range(0, len(left), PART_ROWS):
            part = left.iloc[at:at + PART_ROWS]
            hidden = (places < part["since"].to_numpy()[:, None]) | (places >= part["until"].to_numpy()[:, None])
            parts.append(kernel(part, np.stack(part["q"].to_list()) @ vecs.T, hidden, places))
        return pd.concat(parts)

    by = ["__block", "__cut"]
    return cut_queries.groupBy(*by).cogroup(blocks.groupBy(*by)).applyInPandas(meet, out)


def bank_logits(
    queries: DataFrame, keys: str | Sequence[str], bank: DataFrame, *, most: int | None = None,
    temperature: float = TEMPERATURE, key_rows: int = KEY_ROWS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """``keys, n_keys, top, total, lse`` of each query's logits with the keys it sees.

    ``queries`` holds the unique ``keys``, the encoding ``q`` and the places
    ``since`` (first) and ``until`` (behind the last) of what it sees; ``bank`` holds
    ``place, vec``; ``most`` says how many queries see one block of it at most (all, unless told).
    Returned are how many keys were seen, the largest logit, the sum of the logits and the
    logarithm of the sum of their exponentials, for queries that see any.

    Blocks of the bank give sums that are scaled by a whole exponent and added
    up by it, so their number does not matter and nothing overflows.
    """
    keys = as_list(keys)
    out = T.StructType([
        *queries.select(*keys).schema, T.StructField("n_keys", T.LongType()),
        *[T.StructField(c, T.DoubleType()) for c in ("top", "total", "scaled")],
    ])

    def add_up(part: pd.DataFrame, products: np.ndarray, hidden: np.ndarray, places: np.ndarray) -> pd.DataFrame:
        z = np.where(hidden, -np.inf, products / temperature)
        top = z.max(axis=1)
        some = np.isfinite(top)
        z, hidden = z[some], hidden[some]
        return part.loc[some, keys].assign(
            n_keys=(~hidden).sum(axis=1), top=top[some], total=np.where(hidden, 0.0, z).sum(axis=1),
            scaled=np.exp(z - np.floor(top[some])[:, None]).sum(axis=1),
        )

    most = queries.count() if most is None else most
    # Dealt by query once; both sums below and a join on the keys need no other shuffle.
    partial = _met(queries, keys, bank, add_up, out, most, key_rows, query_rows).repartition(*keys)
    level = F.floor("top")
    # As many levels as whole numbers between a query's smallest and largest block maximum.
    levels = partial.groupBy(*keys, level.alias("__level")).agg(
        F.sum("n_keys").alias("n_keys"), F.max("top").alias("top"), F.sum("total").alias("total"), F.sum("scaled").alias("scaled")
    )
    merged = levels.groupBy(*keys).agg(
        F.sum("n_keys").alias("n_keys"), F.max("top").alias("top"), F.sum("total").alias("total"),
        F.collect_list(F.struct("__level", "scaled")).alias("__levels"),
    )
    scaled = F.aggregate("__levels", F.lit(0.0), lambda s, x: s + x["scaled"] * F.exp(x["__level"] - F.col("top")))
    return merged.select(*keys, "n_keys", "top", "total", (F.col("top") + F.log(scaled)).alias("lse"))


def nearest_keys(
    queries: DataFrame, keys: str | Sequence[str], bank: DataFrame, n: int = 1, *,
    temperature: float = TEMPERATURE, key_rows: int = KEY_ROWS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """``keys, rank, place, logit``: the ``n`` largest logits among the keys that each query sees, ties to the older key.

    Every block gives its ``n`` best; those are ranked again over the blocks.
    """
    keys = as_list(keys)
    out = T.StructType([
        *queries.select(*keys).schema, T.StructField("place", T.LongType()), T.StructField("logit", T.DoubleType())
    ])

    def best(part: pd.DataFrame, products: np.ndarray, hidden: np.ndarray, places: np.ndarray) -> pd.DataFrame:
        z = np.where(hidden, -np.inf, products / temperature)
        order = np.argsort(-z, axis=1, kind="stable")[:, :n]
        logit = np.take_along_axis(z, order, 1)
        row, col = np.nonzero(np.isfinite(logit))
        return part[keys].iloc[row].assign(place=places[order[row, col]], logit=logit[row, col])

    found = _met(queries, keys, bank, best, out, queries.count(), key_rows, query_rows)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("logit"), "place"))
    return found.withColumn("rank", rank).where(F.col("rank") <= n).select(*keys, "rank", "place", "logit")


def _sees(df: DataFrame, keys: list[str], q: str, since: Column, until: Column) -> DataFrame:
    return df.select(*keys, doubles(F.col(q)).alias("q"), since.cast("bigint").alias("since"), until.cast("bigint").alias("until"))


def _with_loss(df: DataFrame, keys: list[str], q: str, k: str, logits: DataFrame, temperature: float, *more: str) -> DataFrame:
    own = positive_logit(df, q, k, "l_pos").select(*keys, *more, (F.col("l_pos") / temperature).alias("l_pos"))
    top = F.greatest("l_pos", F.coalesce("lse", "l_pos"))
    # The own key comes first among the logits; without others its loss is 0.
    every = F.when(F.col("lse").isNull(), F.col("l_pos")).otherwise(
        top + F.log(F.exp(F.col("l_pos") - top) + F.exp(F.col("lse") - top))
    )
    return own.join(logits, keys, "left").select(
        *keys, *more, F.coalesce("n_keys", F.lit(0)).cast("bigint").alias("n_keys"), "l_pos",
        F.col("top").alias("neg_max"), F.coalesce("total", F.lit(0.0)).alias("neg_sum"), (every - F.col("l_pos")).alias("loss"),
    )


def contrastive_logits(
    df: DataFrame, keys: str | Sequence[str], q: str, k: str, bank: DataFrame, temperature: float = TEMPERATURE, **blocks: int
) -> DataFrame:
    """Each query against its own key and every key of a bank ``place, vec`` (see :func:`bank_places`).

    Returns ``keys, n_keys, l_pos, neg_max, neg_sum, loss``: the number of
    bank keys, the own logit, the largest and the sum of the others, and the loss of
    picking the own key. The logits themselves stay in the blocks; :func:`nearest_keys`
    gives the largest ones. ``keys`` name one query each.
    """
    keys = as_list(keys)
    size = bank.agg(F.coalesce(F.max("place") + 1, F.lit(0))).first()[0]
    logits = bank_logits(_sees(df, keys, q, F.lit(0), F.lit(size)), keys, bank, temperature=temperature, **blocks)
    return _with_loss(df, keys, q, k, logits, temperature)


def info_nce(
    df: DataFrame, keys: str | Sequence[str], q: str, k: str, bank: DataFrame, temperature: float = TEMPERATURE, **blocks: int
) -> DataFrame:
    """``keys, loss``: the loss of picking the own key among all."""
    keys = as_list(keys)
    return contrastive_logits(df, keys, q, k, bank, temperature, **blocks).select(*keys, "loss")


def bank_by_step(
    df: DataFrame, order: str, q: str, k: str, *, batch: int, size: int = BANK_SIZE, start: DataFrame | None = None,
    temperature: float = TEMPERATURE, **blocks: int,
) -> DataFrame:
    """Each batch against the bank as it was before it, its own keys entering afterwards.

    Rows come in ``order`` (a unique integer), ``batch`` at a time. The bank is a ring of the
    newest ``size`` keys (a multiple of ``batch``): step t overwrites the slots from ``t * batch % size`` on. So
    the keys that a batch sees are those ranked within ``size`` before its
    first row, a window of ranks, and all steps are worked out at once by blocks of them.
    ``start`` (``slot, vec``) fills the ring before the first step; without it the bank starts empty.

    Returns ``order, batch_id, n_keys, l_pos, neg_max, neg_sum, loss`` and the ``slot`` that the row's key takes.
    """
    if batch <= 0 or size % batch:
        raise ValueError("the bank's size must be a multiple of the batch's")
    ranked = running_position(df.select(order, q, k), None, order, "rank")
    ranked = ranked.withColumn("batch_id", F.floor(F.col("rank") / batch)).withColumn("slot", F.pmod("rank", F.lit(size)))
    # Places are ranks, moved up by the ring that may have been there before.
    begin = F.col("batch_id") * batch
    oldest = begin if start is not None else F.greatest(begin, F.lit(size))
    bank = ranked.select((F.col("rank") + size).alias("place"), doubles(F.col(k)).alias("vec"))
    if start is not None:
        bank = bank.unionByName(start.select(F.col("slot").cast("bigint").alias("place"), doubles(F.col("vec")).alias("vec")))
    seen = _sees(ranked, [order], q, oldest, begin + size)
    # A block is seen by the batches whose windows reach into it.
    most = blocks.get("key_rows", KEY_ROWS) + size + batch
    logits = bank_logits(seen, order, bank, most=most, temperature=temperature, **blocks)
    return _with_loss(ranked, [order], q, k, logits, temperature, "batch_id", "slot")
