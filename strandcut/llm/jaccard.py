"""Operator 6: n-gram Jaccard self join, size-aware: subsets for small sets, inverted lists for large ones."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from strandcut.llm.arrow import slices
from strandcut.llm.common import dropped, stored
from strandcut.llm.graph import components
from strandcut.llm.registry import query, table

#: Shingle counts are kept by bucket; the number of buckets is fixed, so their sizes can go to all tasks.
BUCKET_BITS, BLOCK = 21, 4_096
#: Bits of the map of texts whose sets are wanted.
MAP_BITS = 24
#: Longs of a set's parity sketch, a power of two: about a bit for each element up to the most.
SKETCH_MOST = 64
#: No boundary beyond this: the subsets of larger sets are too many.
SMALL_MOST = 18
#: What moving and comparing two whole sets costs, in rows of an inverted list.
CHECK_COST = 40
#: How many heads of each list its sets are compared with in the second round; in the first it is one.
HEADS = 8
WORDS_KEPT = 100_000
NO_ID = -(1 << 63)
P = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_set(text: str | None, words: dict, width: int = 4) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; A-Z is lower-cased, six white characters part words."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, parts), np.uint64, len(parts))
    width, short = min(width, len(parts)), len(parts) if len(parts) < width else 0
    n = len(h) - width + 1
    out = np.full(n, short, np.uint64)
    for k in range(width):
        out = out * P + h[k:k + n]
    return np.unique(_mixed(out))


def overlap_needed(n: int, m: int, percent: int = 85) -> int:
    """The least intersection of sets of ``n`` and ``m`` that makes them similar."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_lengths(n: int, percent: int = 85) -> tuple[int, int]:
    """How many first elements must hold a shared one: when the partner is no smaller, and for any partner."""
    return n - overlap_needed(n, n, percent) + 1, n - -(-percent * n // 100) + 1


def partner_sizes(n: int, percent: int = 85) -> range:
    return range(-(-percent * n // 100), 100 * n // percent + 1)


def subset_count(n: int, most: int, percent: int = 85) -> int:
    return sum(comb(n, overlap_needed(n, m, percent)) for m in partner_sizes(n, percent) if m <= most)


def subset_keys(elements: list[int], most: int, percent: int = 85) -> Iterator[tuple[int, bool]]:
    """A key for each fixed-size subset that a similar set of each size must share.

    With each key: whether this set is the smaller (or equal) one of its pair of sizes.
    """
    n = len(elements)
    for m in partner_sizes(n, percent):
        if m <= most:
            for some in combinations(elements, overlap_needed(n, m, percent)):
                key = np.array([min(n, m), max(n, m), *some], np.uint64).tobytes()
                yield xxhash.xxh64_intdigest(key) - (1 << 63), n <= m


def parity_sketch(s: np.ndarray) -> np.ndarray:
    """One bit for each of 64 to 4,096 parts of the set, by its size: is the number of its elements there odd.

    Every element that only one of two sets holds turns one bit, so sketches differ in no more bits than there are such elements.
    Halves of a sketch laid over one another by exclusive or are the sketch of half as many parts.
    """
    width = 64
    while width < 0.7 * len(s) and width < 64 * SKETCH_MOST:
        width *= 2
    odd = np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def choose_boundary(sizes: dict[int, int], list_length: float, percent: int = 85) -> int:
    """The largest size whose sets are joined by subsets: least estimated rows in all.

    Sets just below the boundary are in the inverted lists too, for partners above it.
    """
    def scan(n: int) -> float:
        index, probe = prefix_lengths(n, percent)
        return index + probe + probe * list_length * CHECK_COST

    def cost(x: int) -> float:
        low = min(partner_sizes(x + 1, percent))
        return sum(c * subset_count(n, x, percent) for n, c in sizes.items() if n <= x) + sum(
            c * scan(n) for n, c in sizes.items() if low <= n <= SMALL_MOST
        )

    return min(range(1, SMALL_MOST + 1), key=cost)


def _sums(docs: DataFrame, width: int) -> np.ndarray:
    """How often each bucket of shingles occurs, over all documents."""
    blocks = (1 << BUCKET_BITS) // BLOCK

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, total = _Words(), np.zeros(1 << BUCKET_BITS, np.uint32)
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for part in slices(batch, 0):
                for text in part.column(0).to_pylist():
                    held.append(shingle_set(text, words, width) >> np.uint64(64 - BUCKET_BITS))
                    size += len(held[-1])
                    if size > 1 << 20:
                        total += np.bincount(np.concatenate(held).astype(np.int64), minlength=len(total)).astype(np.uint32)
                        held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held).astype(np.int64), minlength=len(total)).astype(np.uint32)
        for start in range(0, blocks, 64):
            some = [b for b in range(start, start + 64) if total[b * BLOCK:(b + 1) * BLOCK].any()]
            # A task's counts are small: a byte each, mostly.
            parts = [total[b * BLOCK:(b + 1) * BLOCK] for b in some]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some, pa.int32()), pa.array([c.astype(np.min_scalar_type(c.max())).tobytes() for c in parts], pa.binary())],
                names=["block", "counts"],
            )

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(BLOCK, np.uint64)
        for counts in rows["counts"]:
            total += np.frombuffer(counts, f"u{len(counts) // BLOCK}")
        # A byte for the magnitude is enough to put the frequent ones last.
        level = np.minimum(255, 8 * np.log2(total + 1.0)).astype(np.uint8)
        return pd.DataFrame({"block": [rows["block"].iloc[0]], "level": [level.tobytes()]})

    found = docs.select("text").mapInArrow(count, "block int, counts binary").groupBy("block").applyInPandas(
        add, "block int, level binary"
    )
    out = np.zeros(1 << BUCKET_BITS, np.uint8)
    for row in found.collect():
        out[row["block"] * BLOCK:(row["block"] + 1) * BLOCK] = np.frombuffer(row["level"], np.uint8)
    return out


SETS = pa.schema([
    ("doc_id", pa.int64()), ("spot", pa.int64()), ("n", pa.int32()), ("cid", pa.binary()), ("sketch", pa.list_(pa.int64())),
    ("small", pa.binary()),
    ("prefix", pa.list_(pa.int64())),
])


def _spot() -> Column:
    """A text's place in the map of wanted texts: copies share one, documents without an id do not."""
    return F.pmod(F.xxhash64("text"), F.lit(1 << MAP_BITS)).cast("long")


def _described(docs: DataFrame, percent: int, width: int, also: list[str]) -> DataFrame:
    """Size, class id, sketch, small set and rare-first prefix of every document's set, with the columns ``also``."""
    levels = docs.sparkSession.sparkContext.broadcast(_sums(docs, width))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, level = _Words(), levels.value
        for batch in batches:
            for part in slices(batch, 1):
                rows = []
                for doc_id, text, spot in zip(*[c.to_pylist() for c in part.columns[:3]]):
                    s = shingle_set(text, words, width)
                    n = len(s)
                    order = (level[s >> np.uint64(64 - BUCKET_BITS)].astype(np.uint64) << np.uint64(56)) | (s >> np.uint64(8))
                    first = s[np.argsort(order, kind="stable")][:prefix_lengths(n, percent)[1]] if n else s
                    rows.append((
                        doc_id, spot, n, xxhash.xxh3_128_digest(s.tobytes()), parity_sketch(s).tolist(),
                        s.tobytes() if n <= SMALL_MOST else None, first.view(np.int64).tolist(),
                    ))
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(c, f.type) for c, f in zip(zip(*rows), SETS)], *part.columns[3:]], names=[*SETS.names, *also]
                )

    schema = T._parse_datatype_string("doc_id long, spot long, n int, cid binary, sketch array<long>, small binary, prefix array<long>")
    for name in also:
        schema = schema.add(docs.schema[name])
    return docs.select("doc_id", "text", _spot(), *also).mapInArrow(describe, schema)


def _subset_links(classes: DataFrame, boundary: int, percent: int) -> DataFrame:
    """Links among small sets: who shares a subset key is similar, no comparison needed."""
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for node, small in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = subset_keys(np.frombuffer(small, np.uint64).tolist(), boundary, percent)
                out += [(key, lower, node) for key, lower in found]
                if len(out) > 50_000:
                    yield pa.RecordBatch.from_pylist([dict(zip(KEYS.names, o)) for o in out], schema=KEYS)
                    out = []
            yield pa.RecordBatch.from_pylist([dict(zip(KEYS.names, o)) for o in out], schema=KEYS)

    small = classes.where((F.col("n") > 0) & (F.col("n") <= boundary)).select("node", "small")
    rows = small.mapInArrow(keys, "key long, lower boolean, node long")
    # All sets of a key are similar to its smaller ones, so one of those stands for the key.
    heads = rows.groupBy("key").agg(
        F.min(F.when(F.col("lower"), F.col("node"))).alias("b"), F.count(F.lit(1)).alias("k")
    ).where("k > 1 AND b IS NOT NULL")
    return rows.join(heads, "key").where("node <> b").select(F.col("node").alias("a"), "b").distinct()


KEYS = pa.schema([("key", pa.int64()), ("lower", pa.bool_()), ("node", pa.int64())])


def _wanted_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``cid, elements``: whole sets of at least the ``wanted`` spots, by a fixed-size map of them; each set once."""
    size = 1 << MAP_BITS

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size, bool)
        for batch in batches:
            seen[batch.column(0).to_numpy() % size] = True
        bits = np.packbits(seen)
        some = [b for b in range(0, len(bits), BLOCK) if bits[b:b + BLOCK].any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([b // BLOCK for b in some], pa.int32()), pa.array([bits[b:b + BLOCK].tobytes() for b in some], pa.binary())],
            names=["block", "bits"],
        )

    def either(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(BLOCK, np.uint8)
        for bits in rows["bits"]:
            total |= np.frombuffer(bits, np.uint8)
        return pd.DataFrame({"block": [rows["block"].iloc[0]], "bits": [total.tobytes()]})

    found = wanted.select(F.col("spot").alias("at")).mapInArrow(mark, "block int, bits binary").groupBy("block").applyInPandas(
        either, "block int, bits binary"
    )
    bits = np.zeros(size // 8, np.uint8)
    for row in found.collect():
        bits[row["block"] * BLOCK:(row["block"] + 1) * BLOCK] = np.frombuffer(row["bits"], np.uint8)
    held = docs.sparkSession.sparkContext.broadcast(bits)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, bits, seen = _Words(), held.value, set()
        for batch in batches:
            at = batch.column(0).to_numpy()
            batch = batch.filter(pa.array((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)))
            for part in slices(batch, 1):
                some = [shingle_set(t, words, width).tobytes() for t in part.column(1).to_pylist()]
                new = {c: s for c, s in ((xxhash.xxh3_128_digest(s), s) for s in some) if c not in seen}
                seen.update(new)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(new), pa.binary()), pa.array(list(new.values()), pa.binary())], names=["cid", "elements"]
                )

    # Copies of one text are made in many tasks. What the map lets through besides is in no pair.
    return docs.select(_spot().alias("at"), "text").mapInArrow(sets, "cid binary, elements binary").dropDuplicates(["cid"])


def _may_be_similar(x: str, y: str, percent: int) -> Column:
    """Whether sizes ``n`` and sketches ``s`` of the sides ``x`` and ``y`` leave room for a similar pair."""
    nx, ny, sx, sy = F.col(f"n{x}"), F.col(f"n{y}"), F.col(f"s{x}"), F.col(f"s{y}")
    width = F.least(F.size(sx), F.size(sy))
    xor = lambda a, b: a.bitwiseXOR(b)
    fold = lambda c: F.when(
        F.size(c) > width, F.zip_with(F.slice(c, F.lit(1), width), F.slice(c, width + 1, width), xor)
    ).otherwise(c)
    apart = F.aggregate(F.zip_with(fold(sx), fold(sy), xor), F.lit(0), lambda t, v: t + F.bit_count(v))
    needed = F.ceil(percent * (nx + ny) / (100 + percent))
    # Sets too different in size to be folded once are not told apart here.
    far = F.greatest(F.size(sx), F.size(sy)) > 2 * width
    return (100 * F.least(nx, ny) >= percent * F.greatest(nx, ny)) & (far | (apart <= nx + ny - 2 * needed))


def _by_sketch(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` that sizes and sketches do not rule out."""
    side = lambda s: classes.select(F.col("node").alias(s), F.col("sketch").alias(f"s{s}"), F.col("n").alias(f"n{s}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(_may_be_similar("a", "b", percent)).select("a", "b")


def _ordered(x: str, y: str) -> list[Column]:
    """The pair as ``a, b``, always the same way round: by a hash, as the heads of all lists at first."""
    x, y = F.col(x), F.col(y)
    first = F.struct(F.xxhash64(x), x) < F.struct(F.xxhash64(y), y)
    return [F.when(first, x).otherwise(y).alias("a"), F.when(first, y).otherwise(x).alias("b")]


def _similar(pairs: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs ``a, b`` whose whole sets are similar."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.filter(pa.array(good, pa.bool_())).select([0, 1])

    for s in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("node").alias(s), F.col("cid").alias(f"c{s}")), s)
    # Both joins read one shuffle of the sets, by their class id.
    side = lambda s: sets.select(F.col("cid").alias(f"c{s}"), F.col("elements").alias(f"e{s}"))
    return pairs.join(side("a"), "ca").join(side("b"), "cb").select("a", "b", "ea", "eb").mapInArrow(check, "a long, b long")


def jaccard_groups(
    docs: DataFrame, *, percent: int = 85, width: int = 4, id_col: str = "doc_id", text_col: str = "text",
    also: Sequence[str] = (),
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document: groups linked by ``percent`` Jaccard.

    Documents of equal sets are one class from the start. Classes up to a
    boundary, chosen by cost from the sizes, enumerate the fixed-size subsets
    that similar sets share. Larger ones (and those whose partners may lie
    beyond the boundary) are in inverted lists of their prefixes, rare shingles
    first by counts over all documents. In a list, two rounds compare all sets
    with a few, its heads, which then leave it; what is in one component needs no
    more pairs. The pairs of different components that remain are all compared,
    so no link is lost.

    Null and empty texts have no shingles and stand alone; without an id their
    component is null, as is that of a group none of which has an id. Repeated
    rows stay; an empty table gives no rows. Columns named in ``also`` are kept, and with them comes
    ``component``, which tells groups apart that have no id (null without shingles); others are left out.
    Equality of shingles is that of 64-bit hashes, of whole sets of 128 bits.
    """
    also = list(also)
    docs = docs.select(F.coalesce(id_col, F.lit(NO_ID)).alias("doc_id"), F.col(text_col).alias("text"), *also)
    real = lambda c: F.nullif(F.col(c), F.lit(NO_ID))
    # Rows are numbered as they are written; a class goes by its first one.
    described = stored(
        _described(docs, percent, width, also).withColumn("row", F.monotonically_increasing_id()), "jaccard-sets"
    )
    whole = described.where("n > 0")
    heads = whole.groupBy("cid").agg(
        F.coalesce(F.min(real("doc_id")), F.lit(NO_ID)).alias("least"), F.min("row").alias("node")
    )
    heads = stored(heads, "jaccard-heads")
    # One document stands for its class.
    wide = stored(
        whole.join(heads.select(F.col("node").alias("row"), "cid"), ["row", "cid"], "left_semi").select(
            F.col("row").alias("node"), "cid", "spot", "n", "sketch", "small", "prefix"
        ), "jaccard-wide",
    )
    rows_of = stored(described.select("doc_id", "n", "cid", *also), "jaccard-documents")
    dropped(described)
    # A list's head is the first of its sets in one order of all, so that lists of the same sets have the same one.
    of_list = Window.partitionBy("token")
    lists = wide.select(F.posexplode("prefix").alias("pos", "token"), "node", "n").select(
        "*", F.count(F.lit(1)).over(of_list).alias("k"), F.min(F.struct(F.xxhash64("node").alias("h"), "node", "n")).over(of_list).alias("head")
    ).where("k > 1")
    shared = stored(lists.select("token", "node", "n", "pos", F.col("head.node").alias("head"), F.col("head.n").alias("nhead")), "jaccard-lists")
    postings = wide.agg(F.sum(F.size("prefix"))).first()[0] or 0
    classes = stored(wide.drop("prefix"), "jaccard-classes")
    dropped(wide)
    sizes = {r["n"]: r["count"] for r in classes.where(F.col("n") <= SMALL_MOST).groupBy("n").count().collect()}
    boundary = choose_boundary(sizes, shared.count() / max(1, postings), percent)
    low = min(partner_sizes(boundary + 1, percent))
    left = shared.where(F.col("n") >= low)

    links = stored(_subset_links(classes, boundary, percent), "jaccard-links")
    tried: list[DataFrame] = []

    def open_lists(lists: DataFrame) -> DataFrame:
        """Lists of more than one component, by the links found so far."""
        found = components(links)
        now = lists.select("token", "node", "n", "pos").join(found, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        return now.select("*", F.min("comp").over(of_list).alias("x"), F.max("comp").over(of_list).alias("y")).where("x <> y").drop("x", "y")

    def similar(pairs: DataFrame) -> DataFrame:
        # What was compared in an earlier round is not compared again.
        for before in tried:
            pairs = pairs.join(before, ["a", "b"], "left_anti")
        held = stored(pairs, "jaccard-pairs")
        tried.append(held)
        # Whole sets are made of those texts only that a pair names, which are few.
        named = held.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        sets = _wanted_sets(docs, classes.select("node", "spot").join(named, "node", "left_semi"), width)
        return stored(_similar(held, classes, sets, percent), "jaccard-links")

    near = (100 * F.least("n", "nhead") >= percent * F.greatest("n", "nhead")) & (F.col("node") != F.col("head"))
    pairs = left.where(near).select(*_ordered("node", "head")).distinct()
    links = links.unionByName(similar(_by_sketch(pairs, classes, percent)))
    # All pairs with a head are decided now: linked, ruled out or compared. The list goes on without it.
    left = stored(open_lists(left.where("node <> head")), "jaccard-open")
    dropped(shared)

    # Then an order for each list, so that a set meets many others of its group.
    heads_of = F.array_distinct(F.array(*[
        F.min(F.struct(F.xxhash64("node", "token", F.lit(i)).alias("h"), "node", "comp", "n")).over(of_list) for i in range(HEADS)
    ]))
    headed = left.withColumn("heads", heads_of)
    met = headed.select("node", "comp", "n", F.explode("heads").alias("h")).select(
        "node", "comp", "n", *[F.col(f"h.{c}").alias(a) for c, a in (("node", "head"), ("comp", "chead"), ("n", "nhead"))]
    )
    pairs = met.where(near & (F.col("comp") != F.col("chead"))).select(*_ordered("node", "head")).distinct()
    links = links.unionByName(similar(_by_sketch(pairs, classes, percent)))
    rest = headed.where(~F.array_contains(F.col("heads.node"), F.col("node")))
    last, left = left, stored(open_lists(rest), "jaccard-open")
    dropped(last)

    index_length = F.col("n") - F.ceil(2 * percent * F.col("n") / (100 + percent)).cast("int") + 1
    # The sketches come along, so that the join itself rules out what they can.
    sketched = left.join(classes.select("node", F.col("sketch").alias("s")), "node")
    sides = ("node", "n", "pos", "comp", "s")
    x = sketched.where(F.col("pos") < index_length).select("token", *[F.col(c).alias(f"{c}x") for c in sides])
    y = sketched.select("token", *[F.col(c).alias(f"{c}y") for c in sides])
    # The first shared element of a similar pair lies where enough others can follow.
    after = F.least(F.col("nx") - F.col("posx"), F.col("ny") - F.col("posy"))
    pairs = x.join(y, "token").where(
        (F.col("compx") != F.col("compy")) & (F.col("nx") <= F.col("ny"))
        & (100 * F.col("nx") >= percent * F.col("ny"))
        & ((100 + percent) * after >= percent * (F.col("nx") + F.col("ny")))
        & (F.lit(boundary) < F.col("ny")) & _may_be_similar("x", "y", percent)
    ).select(*_ordered("nodex", "nodey")).distinct()
    links = links.unionByName(similar(pairs))
    dropped(left, *tried)

    found = components(links)
    comp = heads.join(found, "node", "left").select("cid", "least", F.coalesce("comp", "node").alias("comp"))
    names = comp.groupBy("comp").agg(F.min(real("least")).alias("component_id"), F.min("cid").alias("component"))
    more = [*also, *["component"] * bool(also)]
    named = comp.select("cid", "comp").join(names, "comp").drop("comp")
    linked = rows_of.where("n > 0").join(named, "cid").select(
        real("doc_id").alias("doc_id"), F.col("n").cast("bigint").alias("n_shingles"), "component_id", *more
    )
    alone = rows_of.where("n = 0").withColumn("component", F.lit(None).cast("binary")).select(
        real("doc_id").alias("doc_id"), F.lit(0).cast("bigint").alias("n_shingles"), real("doc_id").alias("component_id"), *more
    )
    return linked.unionByName(alone)


@query("op6_ngram_jaccard_join")
def ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"))
