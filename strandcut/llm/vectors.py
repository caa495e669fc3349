"""Operator 10: exact top-k inner products by dual cover trees."""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandcut.llm.common import stored
from strandcut.llm.registry import query, table

#: Vectors of one data tree, queries of one query tree, points of a leaf.
BLOCK, GROUP, LEAF = 4_096, 512, 48
#: A child's covering radius is its parent's divided by this.
SHRINK = 1.3
LOWEST = np.iinfo(np.int64).min + 1


class CoverTree:
    """Points in tree order; node ``i`` covers the slice ``lo[i]:hi[i]`` by ``radius[i]`` around ``centre[i]``.

    Built from the top: the farthest uncovered point becomes the next child
    centre until all points lie within the smaller radius of one. Children of a
    few points are pooled, so that leaves are worth a matrix product.
    """

    def __init__(self, ids: np.ndarray, points: np.ndarray) -> None:
        # Exact in doubles as long as no product of two vectors can pass 2 ** 53.
        self.points = points.astype(np.float64)
        self.lo, self.hi, self.radius, self.centre, self.children = [], [], [], [], []
        order: list[int] = []
        self._node(np.arange(len(ids)), 0, order)
        self.centre = np.array(self.centre)
        self.radius, self.lo, self.hi = (np.array(x) for x in (self.radius, self.lo, self.hi))
        self.norm = np.sqrt((self.centre ** 2).sum(1))
        self.ids, self.exact, self.points = ids[order], points[order], self.points[order]

    def _node(self, members: np.ndarray, first: int, order: list[int]) -> int:
        at = len(self.lo)
        centre = self.points[members[first]]
        away = np.sqrt(((self.points[members] - centre) ** 2).sum(1))
        radius = float(away.max())
        self.lo.append(len(order))
        self.hi.append(len(order) + len(members))
        # Rounding must not shrink a radius.
        self.radius.append(radius * (1 + 1e-9) + 1e-6)
        self.centre.append(centre)
        self.children.append([])
        if len(members) <= LEAF or radius == 0:
            order.extend(members.tolist())
            return at
        reach, nearest, owner = radius / SHRINK, away, np.zeros(len(members), np.int64)
        centres = [first]
        while nearest.max() > reach:
            new = int(nearest.argmax())
            away = np.sqrt(((self.points[members] - self.points[members[new]]) ** 2).sum(1))
            closer = away < nearest
            owner[closer], nearest = len(centres), np.minimum(nearest, away)
            centres.append(new)
        pool = []
        for k, c in enumerate(centres):
            own = np.flatnonzero(owner == k)
            if len(own) * 2 <= LEAF:
                pool.append(own)
            elif len(own) < len(members):
                self.children[at].append(self._node(members[own], int(np.flatnonzero(own == c)[0]), order))
        rest = np.concatenate(pool) if pool else np.zeros(0, np.int64)
        for i in range(0, len(rest), LEAF):
            self.children[at].append(self._node(members[rest[i:i + LEAF]], 0, order))
        return at

    @classmethod
    def stored(cls, data: bytes) -> CoverTree:
        tree = cls.__new__(cls)
        vars(tree).update(pickle.loads(data))
        return tree

    @property
    def top(self) -> tuple[np.ndarray, float, float]:
        return self.centre[0], float(self.radius[0]), float(self.norm[0])


def bound(dot, radius_a, norm_a, radius_b, norm_b):
    """No two points of two nodes have a larger inner product."""
    return (dot + radius_a * norm_b + radius_b * norm_a + radius_a * radius_b) * 1.0 + 1e-3


class Search:
    """The best ``k`` of one query tree, updated by one data tree after the other."""

    def __init__(self, queries: CoverTree, k: int, worst: np.ndarray) -> None:
        self.q, self.k = queries, k
        n = len(queries.ids)
        self.scores = np.full((n, k), LOWEST)
        self.found = np.full((n, k), np.iinfo(np.int64).max)
        self.worst = worst.astype(np.float64)

    def run(self, data: CoverTree) -> None:
        self.d = data
        todo = [(0, 0)]
        while todo:
            a, b = todo.pop()
            q, d = self.q, data
            rows = slice(q.lo[a], q.hi[a])
            if bound(q.centre[a] @ d.centre[b], q.radius[a], q.norm[a], d.radius[b], d.norm[b]) < self.worst[rows].min():
                continue
            qs, ds = q.children[a], d.children[b]
            if not qs and not ds:
                self._leaves(rows, slice(d.lo[b], d.hi[b]))
            elif ds and (not qs or d.radius[b] >= q.radius[a]):
                most = bound(d.centre[ds] @ q.centre[a], q.radius[a], q.norm[a], d.radius[ds], d.norm[ds])
                # The most promising child is worked on first.
                todo += [(a, ds[i]) for i in np.argsort(most)]
            else:
                todo += [(c, b) for c in qs]

    def _leaves(self, rows: slice, cols: slice) -> None:
        q, d = self.q, self.d
        if self.exact_in_doubles:
            scores = (q.points[rows] @ d.points[cols].T).astype(np.int64)
        else:
            exact = q.exact[rows].astype(object) @ d.exact[cols].astype(object).T
            scores = np.array(exact.tolist(), np.int64).reshape(exact.shape)
        ids = np.broadcast_to(d.ids[cols], scores.shape)
        scores = np.where(ids == q.ids[rows][:, None], LOWEST, scores)
        near = scores >= self.scores[rows][:, -1:]
        if not near.any():
            return
        scores = np.hstack([self.scores[rows], scores])
        ids = np.hstack([self.found[rows], ids])
        ids = np.where(scores == LOWEST, np.iinfo(np.int64).max, ids)
        best = np.lexsort((ids, -scores), axis=1)[:, :self.k]
        self.scores[rows] = np.take_along_axis(scores, best, 1)
        self.found[rows] = np.take_along_axis(ids, best, 1)
        self.worst[rows] = np.maximum(self.worst[rows], self.scores[rows][:, -1])

    @property
    def exact_in_doubles(self) -> bool:
        return max(abs(self.q.exact).max(initial=0), 1) * max(abs(self.d.exact).max(initial=0), 1) * max(
            1, self.q.exact.shape[1]) < 2 ** 53


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, and all components finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False))


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    rows = df.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull())
    return rows.select(
        F.col(id_col).alias("vec_id"),
        F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("bigint")).alias("v"),
    )


TREES = "part long, tree binary, centre array<double>, radius double, norm double"


def trees(vectors: DataFrame, part: Column, width: int) -> DataFrame:
    """One cover tree per ``part``; shorter vectors end in zeros."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        points = np.zeros((len(rows), width), np.int64)
        for i, v in enumerate(rows["v"]):
            points[i, :len(v)] = v
        tree = CoverTree(rows["vec_id"].to_numpy(np.int64), points)
        centre, radius, norm = tree.top
        return pd.DataFrame([(rows["part"].iloc[0], pickle.dumps(vars(tree)), centre.tolist(), radius, norm)],
                            columns=["part", "tree", "centre", "radius", "norm"])

    return vectors.withColumn("part", part).groupBy("part").applyInPandas(build, TREES)


FOUND = "part long, query_id long, vec_id long, score long"


def _search(pairs: DataFrame, k: int) -> DataFrame:
    """Rows ``part, block, q_tree, d_tree, worst`` to at most ``k`` hits for each query of each pair."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in rows.itertuples():
            queries = CoverTree.stored(row.q_tree)
            known = dict(zip(row.query_ids, row.worst)) if row.query_ids is not None else {}
            worst = np.array([known.get(i, LOWEST) for i in queries.ids.tolist()], np.float64)
            search = Search(queries, k, worst)
            search.run(CoverTree.stored(row.d_tree))
            real = search.scores > LOWEST
            owner = np.repeat(queries.ids, real.sum(1))
            out.append(pd.DataFrame({
                "part": row.part, "query_id": owner, "vec_id": search.found[real], "score": search.scores[real],
            }))
        return pd.concat(out)

    return pairs.groupBy("part", "block").applyInPandas(run, FOUND)


def top_products(
    vectors: DataFrame, is_query: Column, k: int = 5, *, id_col: str = "vec_id", vector_col: str = "embedding",
    block: int = BLOCK, group: int = GROUP,
) -> DataFrame:
    """The ``k`` largest integer inner products of every query with all other rows.

    Components become ``floor(256 * x)``. Vectors that are null, hold a null or
    a non-finite component, or have a null id take no part; vectors of unequal
    length are filled up with zeros. Ties go to the smaller id; a query finds no
    row of its own id; with fewer candidates all are returned. Rows of one id are
    one candidate each.

    Data and queries are dealt into blocks and groups, each indexed by a cover
    tree. Each group first searches its most promising block. The worst kth
    score it has then rules out whole blocks by their covering radii, and inside
    the remaining pairs the two trees are walked together. No task holds more
    than one block and one group.
    """
    base = whole_vectors(vectors, id_col, vector_col)
    base = stored(base.withColumn("q", F.coalesce(is_query, F.lit(False))), "vectors")
    rows, asked, width = base.agg(
        F.count(F.lit(1)), F.count_if("q"), F.coalesce(F.max(F.size("v")), F.lit(0))
    ).first()
    blocks, groups = -(-rows // block) or 1, -(-asked // group) or 1
    part = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n))
    data = stored(trees(base.select("vec_id", "v"), part(blocks, 1), width), "data-trees").withColumnRenamed("part", "block")
    queries = stored(
        trees(base.where("q").dropDuplicates(["vec_id"]).select("vec_id", "v"), part(groups, 2), width), "query-trees"
    )
    # Roots only: every group with every block, before any vector moves.
    each = queries.drop("tree").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")))
    dot = F.aggregate(F.zip_with("centre", "d_centre", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    roots = each.join(
        data.select("block", F.col("centre").alias("d_centre"), F.col("radius").alias("d_radius"), F.col("norm").alias("d_norm")),
        "block",
    ).select("part", "block", bound(dot, F.col("radius"), F.col("norm"), F.col("d_radius"), F.col("d_norm")).alias("most"))
    first = roots.groupBy("part").agg(F.max_by("block", F.struct("most", "block")).alias("block"))

    def with_trees(pairs: DataFrame) -> DataFrame:
        return pairs.join(queries.select("part", F.col("tree").alias("q_tree")), "part").join(
            data.select("block", F.col("tree").alias("d_tree")), "block"
        )

    nothing = [F.lit(None).cast("array<long>").alias("query_ids"), F.lit(None).cast("array<long>").alias("worst")]
    early = stored(_search(with_trees(first.select("part", "block", *nothing)), k), "first-hits")
    # A query without k hits so far can rule out nothing.
    kth = early.groupBy("part", "query_id").agg(F.min("score").alias("worst"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    known = kth.groupBy("part").agg(
        F.collect_list("query_id").alias("query_ids"), F.collect_list("worst").alias("worst"),
        F.min("worst").alias("least"), F.count(F.lit(1)).alias("full"),
    )
    sizes = base.where("q").select("vec_id").distinct().groupBy(part(groups, 2).alias("part")).agg(F.count(F.lit(1)).alias("asked"))
    left = (
        roots.join(first.withColumnRenamed("block", "done"), "part").where("block <> done")
        .join(sizes, "part").join(known, "part", "left")
        .where(F.coalesce(F.col("full"), F.lit(0)).__lt__(F.col("asked")) | (F.col("most") >= F.col("least")))
    )
    late = _search(with_trees(left.select("part", "block", "query_ids", "worst")), k)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    hits = early.unionByName(late).withColumn("rank", F.row_number().over(order))
    return hits.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


TOP_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
WHERE rank <= 5
"""


@query("op10_exact_topk", TOP_SQL)
def exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)
