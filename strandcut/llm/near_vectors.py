"""Operator 12: near duplicates among embeddings by randomised-rotation binary codes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandcut.llm.common import dropped, stored
from strandcut.llm.graph import components
from strandcut.llm.registry import query, table
from strandcut.llm.vectors import usable
from strandcut.operators.ordering import ordered_index

LEAST, SEED = 0.9, 12
#: Vectors that share one value of a band on average, and the chance of a pair right at the threshold to share a band.
BAND_ROWS, FOUND = 32, 0.95
#: Bands that are shuffled at a time.
ROUND = 6
#: Vectors that are compared with each other in one place; larger groups are cut into blocks of as many.
GROUP = 2_048
#: Standard deviations of an estimate that it may be off: about one pair in 16,000 is further, in one direction.
SIGMAS = 4.0
#: Angles are told apart from here on.
MARGIN = 1e-6


def rotation(width: int, number: int, seed: int = SEED) -> np.ndarray:
    """A random rotation, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng([seed, number, width]).normal(size=(width, width)))
    return q * np.sign(np.diag(r))


def band_plan(rows: int, least: float = LEAST) -> tuple[int, int]:
    """Bits of a band and how many bands: buckets stay small, and few near pairs share none."""
    bits = min(40, max(1, round(math.log2(max(2, rows / BAND_ROWS)))))
    same = (1 - math.acos(least) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - FOUND) / math.log(1 - same))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1; large and tiny entries overflow nothing."""
    vectors = vectors / abs(vectors).max(1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


class Codes:
    """Binary codes of unit vectors: signs after a rotation, the correction factor, and the rotated vector in bytes."""

    def __init__(self, payload: list[bytes], width: int) -> None:
        raw = np.frombuffer(b"".join(payload), np.uint8).reshape(len(payload), -1)
        self.width, at = width, width // 8
        self.signs = np.unpackbits(raw[:, :at], axis=1).astype(np.float32) * 2 - 1
        self.factor, self.step = np.ascontiguousarray(raw[:, at:at + 8]).view(np.float32).T
        self.rotated = raw[:, at + 8:].view(np.int8) * self.step[:, None]

    @staticmethod
    def made(rotated: np.ndarray) -> list[bytes]:
        width = rotated.shape[1]
        bits = np.packbits(rotated > 0, axis=1)
        factor = abs(rotated).sum(1) / math.sqrt(width)
        step = np.maximum(abs(rotated).max(1) / 127, 1e-30)
        small = np.rint(rotated / step[:, None]).astype(np.int8)
        both = np.stack([factor, step], 1).astype(np.float32)
        return [b.tobytes() + f.tobytes() + s.tobytes() for b, f, s in zip(bits, both, small)]

    def maybe(self, rows: slice | np.ndarray, cols: slice | np.ndarray, least: float) -> np.ndarray:
        """Pairs that the confidence bounds of the estimates, taken in both directions, leave open.

        A code's product with a whole vector, divided by the factor, estimates
        the inner product without bias; its error is that of a random direction.
        """
        def upper(code, whole):
            f = self.factor[code][:, None]
            estimate = self.signs[code] @ self.rotated[whole].T / (f * math.sqrt(self.width))
            off = SIGMAS * np.sqrt(np.maximum(1 - f * f, 0)) / (f * math.sqrt(self.width - 1))
            return estimate + off + self.step[whole][None, :] * math.sqrt(self.width) / (2 * f)

        return (upper(rows, cols) >= least) & (upper(cols, rows).T >= least)

    def close(self, rows: slice, least: float) -> np.ndarray:
        """Pairs of ``rows`` that may reach ``least``: of those left open, what the byte-wise products do not rule out."""
        open_ = self.maybe(rows, rows, least)
        if open_.sum() == len(open_):
            return open_
        off = self.step[rows] * math.sqrt(self.width) / 2
        product = self.rotated[rows] @ self.rotated[rows].T
        return open_ & (product + off[:, None] + off[None, :] + off[:, None] * off[None, :] + 1e-5 >= least)


def connected(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix the smallest row of its component."""
    labels = np.arange(len(linked))
    linked = linked | np.eye(len(linked), dtype=bool)
    while True:
        new = np.where(linked, labels[None, :], len(labels)).min(1)
        new = np.minimum(new, new[new])
        if (new == labels).all():
            return labels
        labels = new


def _runs(keys: np.ndarray) -> Iterator[slice]:
    """Slices of equal neighbours."""
    ends = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    for a, b in zip([0, *ends.tolist()], [*ends.tolist(), len(keys)]):
        yield slice(a, b)


def _described(df: DataFrame, id_col: str, vector_col: str, width: int) -> DataFrame:
    """``vec_id, cid, u`` of usable rows: a digest of the vector's values, and the vector at length 1."""
    kind = T.StructType([
        T.StructField("vec_id", df.schema[id_col].dataType), T.StructField("cid", T.BinaryType()),
        T.StructField("u", T.ArrayType(T.DoubleType())),
    ])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            v = np.zeros((batch.num_rows, width))
            sizes = np.diff(column.offsets.to_numpy())
            v[np.arange(width)[None, :] < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
            v += 0.0  # One zero.
            ends = pa.array(np.arange(0, v.size + 1, width, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([xxhash.xxh3_128_digest(row.tobytes()) for row in v], pa.binary()),
                pa.ListArray.from_arrays(ends, pa.array(unit(v).ravel())),
            ], names=["vec_id", "cid", "u"])

    rows = df.where(takes_part(F.col(vector_col)))
    return rows.select(id_col, F.transform(vector_col, lambda x: x.cast("double"))).mapInArrow(describe, kind)


def takes_part(vector: Column) -> Column:
    return F.coalesce(usable(vector) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _encoded(classes: DataFrame, width: int, bits: int, bands: int) -> DataFrame:
    """Adds the code (``payload``) and the values of all bands (``keys``), each told from other bands by its high bits."""
    padded = max(64, -(-width // 64) * 64)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = rotation(padded, 0)
        others = np.hstack([rotation(padded, 1 + i) for i in range(-(-bits * bands // padded))])[:, :bits * bands]
        powers = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            u = np.zeros((batch.num_rows, padded))
            if batch.num_rows:
                u[:, :width] = batch.column("u").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            keys = ((u @ others > 0).reshape(-1, bands, bits) * powers).sum(2) | (np.arange(bands, dtype=np.int64) << 44)
            ends = pa.array(np.arange(0, keys.size + 1, bands, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(Codes.made(u @ first), pa.binary()), pa.ListArray.from_arrays(ends, pa.array(keys.ravel()))],
                names=[*batch.schema.names, "payload", "keys"],
            )

    kind = T.StructType([*classes.schema, T.StructField("payload", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType()))])
    return classes.mapInArrow(encode, kind)


def _bundled(df: DataFrame, key: str, rows: int) -> DataFrame:
    """Adds ``bundle``: whole groups of ``key`` that are worked on in one call."""
    return df.withColumn("bundle", F.pmod(F.xxhash64(key), F.lit(-(-rows // (2 * GROUP)) or 1)))


def _candidates(classes: DataFrame, width: int, bands: int, rows: int, least: float) -> list[DataFrame]:
    """Links ``a, b`` that hold together, band by band, what may be similar; more than is similar, less than all pairs.

    Codes of one bucket are compared in place, and a component of what may be
    similar is told by links to one of its vectors. A bucket beyond ``GROUP``
    becomes one component as it is: what is not similar in it is found out later.
    """
    padded = max(64, -(-width // 64) * 64)

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["key", "cid"])
        codes, cids = Codes(group["payload"].tolist(), padded), group["cid"].to_numpy()
        a, b = [], []
        for run in _runs(group["key"].to_numpy()):
            if run.stop - run.start < 2:
                continue
            close = codes.close(run, least)
            if close.sum() > len(close):
                labels = connected(close)
                some = np.flatnonzero(labels != np.arange(len(labels)))
                a += cids[run][some].tolist()
                b += cids[run][labels[some]].tolist()
        return pd.DataFrame({"a": a, "b": b})

    found = []
    for start in range(0, bands, ROUND):
        keyed = classes.select("cid", "payload", F.explode(F.slice("keys", start + 1, ROUND)).alias("key"))
        large = stored(
            keyed.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.min("cid").alias("head")).where(F.col("k") > GROUP), "near-large"
        )
        small = keyed
        if large.head(1):
            small = keyed.join(large.select("key"), "key", "left_anti")
            found.append(stored(
                keyed.select("cid", "key").join(large, "key").where("cid <> head").select(F.col("cid").alias("a"), F.col("head").alias("b")),
                "near-links",
            ))
        bundled = _bundled(small, "key", rows * min(ROUND, bands))
        found.append(stored(bundled.groupBy("bundle").applyInPandas(meet, "a binary, b binary"), "near-links"))
    return found


HITS = "cid binary, more long, head binary"


def _compared(x: np.ndarray, y: np.ndarray, open_: np.ndarray, least: float) -> np.ndarray:
    """Which open pairs have a cosine of ``least`` in double precision."""
    if open_.sum() * 8 > open_.size:
        return open_ & (x @ y.T >= least)
    linked = np.zeros_like(open_)
    i, j = np.nonzero(open_)
    for at in range(0, len(i), 1 << 16):
        a, b = i[at:at + (1 << 16)], j[at:at + (1 << 16)]
        linked[a, b] = np.einsum("nd,nd->n", x[a], y[b]) >= least
    return linked


def _within(codes: Codes, u: np.ndarray, rows: slice, least: float) -> np.ndarray:
    """The links among ``rows``; each pair is decided once."""
    linked = np.triu(_compared(u[rows], u[rows], np.triu(codes.maybe(rows, rows, least), 1), least), 1)
    return linked | linked.T


def _hits(cids: np.ndarray, copies: np.ndarray, linked: np.ndarray) -> dict[str, list]:
    labels = connected(linked)
    return {"cid": cids.tolist(), "more": (linked @ copies).tolist(), "head": cids[labels].tolist()}


def _near_in_groups(members: DataFrame, width: int, rows: int, least: float) -> DataFrame:
    """``cid, more, head``: copies linked besides its own, and one vector of its component, for whole small groups."""
    padded = max(64, -(-width // 64) * 64)

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["comp", "cid"])
        codes, u = Codes(group["payload"].tolist(), padded), np.stack(group["u"].to_numpy())
        cids, copies = group["cid"].to_numpy(), group["copies"].to_numpy(np.int64)
        out = [
            pd.DataFrame(_hits(cids[run], copies[run], _within(codes, u, run, least)))
            for run in _runs(group["comp"].to_numpy())
        ]
        return pd.concat(out)

    return _bundled(members, "comp", rows).groupBy("bundle").applyInPandas(compare, HITS)


def _near_in_blocks(members: DataFrame, width: int, least: float) -> DataFrame:
    """The same for groups beyond ``GROUP``, in blocks of rising angle to the group's mean direction.

    Angles obey the triangle inequality: two blocks whose angles add up to no
    more than the threshold's are linked throughout, and two that are further
    apart than it nowhere; only the vectors of the other pairs of blocks meet.
    So a dense group costs no comparisons, however many it has.
    """
    padded, theta = max(64, -(-width // 64) * 64), math.acos(least)
    parts = members.select("comp", F.posexplode("u").alias("at", "c")).groupBy("comp", "at").agg(F.sum("c").alias("c"))
    means = parts.groupBy("comp").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "c"))), lambda s: s["c"]).alias("mean"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    cosine = dot("u", "mean") / F.greatest(F.sqrt(dot("mean", "mean")), F.lit(1e-300))
    placed = ordered_index(stored(members.join(means, "comp").select(
        "comp", F.acos(F.greatest(F.least(cosine, F.lit(1.0)), F.lit(-1.0))).alias("angle"), "cid", "copies", "u", "payload",
    ), "near-angles"), ["comp", "angle", "cid"], "idx")
    starts = placed.groupBy("comp").agg(F.min("idx").alias("start"))
    rows = stored(placed.join(starts, "comp").withColumn("block", F.floor((F.col("idx") - F.col("start")) / GROUP)).drop(
        "idx", "start"), "near-blocks")
    blocks = stored(rows.groupBy("comp", "block").agg(
        F.min("angle").alias("lo"), F.max("angle").alias("hi"), F.sum("copies").alias("w"), F.min("cid").alias("head")), "near-block-sums")
    x, y = (blocks.select("comp", *[F.col(c).alias(s + c) for c in ("block", "lo", "hi", "w")]) for s in "xy")
    meeting = x.join(y, "comp").where("yblock >= xblock").where(F.col("ylo") - F.col("xhi") <= theta + MARGIN)
    sure = F.col("xhi") + F.col("yhi") <= theta - MARGIN
    certain = meeting.where(sure)
    whole = certain.select("comp", F.col("xblock").alias("block"), F.col("yw").alias("w")).unionByName(
        certain.where("xblock <> yblock").select("comp", F.col("yblock").alias("block"), F.col("xw").alias("w"))
    ).groupBy("comp", "block").agg(F.sum("w").alias("sure"))
    # Who is linked throughout with any block is so with the innermost one.
    inner = blocks.where("block = 0").select("comp", F.col("hi").alias("inner"), F.col("head").alias("core"))
    mine = rows.select("comp", "block", "cid", "copies").join(whole, ["comp", "block"]).join(inner, "comp").join(
        blocks.select("comp", "block", "hi"), ["comp", "block"])
    within = F.when(2 * F.col("hi") <= theta - MARGIN, F.col("copies")).otherwise(0)
    certain_hits = mine.select("cid", (F.col("sure") - within).alias("more"), F.col("core").alias("head"))

    open_pairs = stored(meeting.where(~sure).select("comp", "xblock", "yblock"), "near-open")

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        same = left["xblock"].iloc[0] == left["yblock"].iloc[0]
        both = left if same else pd.concat([left, right])
        codes, u, n = Codes(both["payload"].tolist(), padded), np.stack(both["u"].to_numpy()), len(left)
        cids, copies = both["cid"].to_numpy(), both["copies"].to_numpy(np.int64)
        if same:
            return pd.DataFrame(_hits(cids, copies, _within(codes, u, slice(0, n), least)))
        across = _compared(u[:n], u[n:], codes.maybe(slice(0, n), slice(n, None), least), least)
        linked = np.zeros((len(both),) * 2, bool)
        linked[:n, n:], linked[n:, :n] = across, across.T
        return pd.DataFrame(_hits(cids, copies, linked))

    keys = ["comp", "xblock", "yblock"]

    def side(block: str) -> DataFrame:
        named = [F.col(c).alias(c) for c in ("comp", "cid", "copies", "u", "payload")]
        pairs = open_pairs.select(*[F.col(c).alias(c) for c in keys])
        return rows.select(*named, F.col("block").alias(block)).join(pairs, ["comp", block]).select(
            *[F.col(c).alias(c) for c in (*keys, "cid", "copies", "u", "payload")])

    met = side("xblock").groupBy(*keys).cogroup(side("yblock").groupBy(*keys)).applyInPandas(compare, HITS)
    return certain_hits.unionByName(met)


def near_vectors(
    embeddings: DataFrame, least: float = LEAST, *, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row: vectors linked by a cosine of ``least`` or more.

    Equal vectors are one class from the start. Each class has a binary code:
    the signs of the randomly rotated unit vector, and the factor that makes
    products with it unbiased estimates. Signs of further rotations, cut into
    bands, say who is compared; bands are as many as leave a pair right at the
    threshold 95 % to meet (nearer ones more). In a bucket, the estimates' bounds
    and byte-wise products leave what may be similar, of which only components are
    kept. Their vectors then come together once, and the pairs that the bounds
    leave open are computed in double precision, so no link is below ``least``.
    Pairs are counted where they are found and never written.

    Null, zero and non-finite vectors, and those holding a null, link with
    nothing; shorter ones are filled up with zeros. Rows of one id are
    vectors of their own. Rows without an id link as others do, but name no
    component; where none of a component has an id it is null, and ``kept``. An
    empty table gives no rows, and other columns are left out.
    """
    rows, width = embeddings.where(takes_part(F.col(vector_col))).agg(
        F.count(F.lit(1)), F.coalesce(F.max(F.size(vector_col)), F.lit(1))
    ).first()
    bits, bands = band_plan(rows, least)
    described = _described(embeddings.select(id_col, vector_col), id_col, vector_col, width)
    classes = described.groupBy("cid").agg(
        F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("u").alias("u")
    )
    classes = stored(_encoded(classes, width, bits, bands), "near-classes")

    candidates = reduce(DataFrame.unionByName, _candidates(classes, width, bands, rows, least))
    found = stored(components(candidates), "near-components")
    members = classes.select("cid", "copies", "u", "payload").join(found, F.col("cid") == F.col("node")).drop("node")
    sizes = stored(found.groupBy("comp").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > GROUP), "near-large")
    if sizes.head(1):
        small = members.join(sizes.select("comp"), "comp", "left_anti")
        hits = _near_in_groups(small, width, rows, least).unionByName(
            _near_in_blocks(members.join(sizes.select("comp"), "comp", "left_semi"), width, least))
    else:
        hits = _near_in_groups(members, width, rows, least)
    hits = stored(hits, "near-hits")

    groups = components(hits.select(F.col("cid").alias("a"), F.col("head").alias("b")))
    more = hits.groupBy("cid").agg(F.sum("more").alias("more"))
    of = classes.select("cid", "least", "copies").join(more, "cid", "left").join(groups, F.col("cid") == F.col("node"), "left")
    of = of.select("cid", "least", (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("comp", "cid").alias("comp"))
    # Written first, so that the join with it is one of two plain shuffles, of which a hot component can be split.
    names = stored(of.groupBy("comp").agg(F.min("least").alias("component_id")), "near-names")
    of = stored(of.join(names, "comp").select("cid", "n_links", "component_id"), "near-result")
    dropped(classes, hits, found)
    out = described.select("vec_id", "cid").join(of, "cid").select("vec_id", "n_links", "component_id")
    alone = embeddings.where(~takes_part(F.col(vector_col))).select(
        F.col(id_col).alias("vec_id"), F.lit(0).cast("bigint").alias("n_links"), F.col(id_col).alias("component_id")
    )
    return out.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


@query("op12_embedding_near_dedup")
def embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
