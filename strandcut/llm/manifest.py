"""Operator 13: a Merkle manifest of a table: content-addressed records, proofs by descent from the root."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandcut.llm.common import stored
from strandcut.llm.registry import query, table
from strandcut.operators.ordering import ordered_index

#: Nodes that become one, and levels that one record spans: it has at most 64 children.
ARITY, LEVELS = 2, 6
WIDTH = ARITY ** LEVELS
#: The tree over the subroots; the trees of the groups are numbered from 0.
TOP = -1
#: Rows of an Arrow batch that are Python objects at once; each holds up to ``WIDTH`` digests.
ROWS = 256


def _h(parts: str) -> str:
    return hashlib.sha256(parts.encode()).hexdigest()


def up(nodes: list[str]) -> list[str]:
    """The next level: every run of ``ARITY`` consecutive digests becomes the digest of its text."""
    return [_h("".join(nodes[i:i + ARITY])) for i in range(0, len(nodes), ARITY)]


def height(n: int) -> int:
    """Levels above ``n`` nodes until one remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def ladder(children: list[str], levels: int) -> list[list[str]]:
    """All levels of one record, its children first, its own digest alone in the last."""
    out = [children]
    for _ in range(levels):
        out.append(up(out[-1]))
    return out


def beside(rungs: list[list[str]], at: int) -> list[str]:
    """For child ``at``, from the record's digest down: what stands left and right of it in its run, level by level."""
    path: list[str] = []
    for rung in rungs[:-1]:
        first = at - at % ARITY
        path = ["".join(rung[first:at]), "".join(rung[at + 1:first + ARITY]), *path]
        at //= ARITY
    return path


def fold(digest: str, path: list[str]) -> str:
    """The root that a leaf and its path (root first) lead to: the path is walked in reverse."""
    for i in range(len(path) - 2, -1, -2):
        digest = _h(path[i] + digest + path[i + 1])
    return digest


def field(col: Column) -> Column:
    """``-`` if null, else the UTF-8 byte count, a colon and the value."""
    text = col.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*cols: Column) -> Column:
    return F.sha2(F.concat(*[field(c) for c in cols]), 256)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield from batch.slice(at, ROWS).to_pylist()


MADE = "tree long, seg long, leaves long, levels int, digest string, children array<string>"


def span(leaves: int, depth: int) -> int:
    """Levels that a record of a tree of ``leaves`` spans, ``depth`` records above the lowest."""
    return min(LEVELS, max(0, height(leaves) - depth * LEVELS))


def _grouped(nodes: DataFrame, *more: str) -> DataFrame:
    """``tree, rank, leaves, digest`` to a row for each ``WIDTH`` consecutive nodes, in order, with ``more`` in ``rows``."""
    groups = nodes.groupBy("tree", F.floor(F.col("rank") / WIDTH).cast("bigint").alias("seg")).agg(
        F.any_value("leaves").alias("leaves"),
        F.sort_array(F.collect_list(F.struct("rank", "digest", *more))).alias("rows"),
    )
    return groups.select(
        "tree", "seg", "leaves", F.transform("rows", lambda r: r["digest"]).alias("children"),
        F.transform("rows", lambda r: F.struct(r["rank"].alias("rank"), *[r[c].alias(c) for c in more])).alias("rows"),
    )


def _records(groups: DataFrame, depth: int) -> DataFrame:
    """The record of each group of consecutive nodes."""
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tree, seg, leaves, children = batch.columns
            levels = [span(n, depth) for n in leaves.to_pylist()]
            digests = [ladder(nodes, k)[-1][0] for k, nodes in zip(levels, children.to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [tree, seg, leaves, pa.array(levels, pa.int32()), pa.array(digests, pa.string()), children],
                names=["tree", "seg", "leaves", "levels", "digest", "children"],
            )

    return stored(groups.select("tree", "seg", "leaves", "children").mapInArrow(made, MADE), "manifest-records")


def grow(groups: DataFrame) -> list[DataFrame]:
    """Records above groups of leaves, lowest depth first; the last depth has one record for each tree.

    A record names the digests up to ``LEVELS`` levels below its own. Each depth
    shuffles the digests of the depth below, a ``WIDTH``-th of its rows. A tree
    that has come to one node passes through the depths that taller trees need.
    """
    most = groups.agg(F.max("leaves")).first()[0] or 0
    depths = [_records(groups, 0)]
    while WIDTH ** len(depths) < most:
        nodes = depths[-1].select("tree", F.col("seg").alias("rank"), "leaves", "digest")
        depths.append(_records(_grouped(nodes), len(depths)))
    return depths


FRONT = "tree long, seg long, leaves long, levels int, digest string, path array<string>"


def _known(records: DataFrame) -> DataFrame:
    """Digest to children: equal subtrees are one record."""
    return records.select("digest", "levels", "children").dropDuplicates(["digest", "levels"])


def _step(front: DataFrame, wanted: DataFrame, records: DataFrame, depth: int) -> DataFrame:
    """From requests at the records of one depth to requests at those children that are wanted."""
    asked = wanted.groupBy("tree", F.floor(F.col("seg") / WIDTH).cast("bigint").alias("seg")).agg(
        F.collect_set("seg").alias("next")
    )
    rows = front.join(asked, ["tree", "seg"]).join(_known(records), ["digest", "levels"])

    def gone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.string())]
        for row in _rows(batches):
            rungs, levels = ladder(row["children"], row["levels"]), span(row["leaves"], depth - 1)
            out = [
                (row["tree"], seg, row["leaves"], levels, row["children"][seg % WIDTH],
                 [*row["path"], *beside(rungs, seg % WIDTH)])
                for seg in row["next"]
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), types)],
                names=["tree", "seg", "leaves", "levels", "digest", "path"],
            )

    return rows.select("tree", "leaves", "levels", "children", "path", "next").mapInArrow(gone, FRONT)


def descend(front: DataFrame, wanted: DataFrame, depths: list[DataFrame], lowest: int = 0) -> DataFrame:
    """Requests at roots followed to the ``wanted`` nodes ``tree, seg`` below the records of depth ``lowest``.

    Each digit of a node's number chooses a child; what stands beside it joins
    the path. A request is one row for all wanted nodes below it, so no record is asked
    for twice, and a step costs a join of two keyed tables.
    """
    for depth in reversed(range(lowest, len(depths))):
        below = wanted.select("tree", F.floor(F.col("seg") / WIDTH ** (depth - lowest)).cast("bigint").alias("seg")).distinct()
        front = _step(front, below, depths[depth], depth)
    return front


PROOFS = "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string"
RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def manifest_proofs(
    docs: DataFrame, *, id_col: str = "doc_id", group_col: str = "lang",
    fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    tampered: Column | None = None, tampered_fields: dict[str, Column] | None = None,
) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row.

    A leaf is the digest of a row's ``fields``. The leaves of one group, by
    ascending id, form a tree in which ``ARITY`` consecutive nodes become one
    until one remains, and so do the groups' subroots in the order of the
    group. ``tampered`` marks rows whose proof is checked with a leaf made with
    ``tampered_fields`` in place of the stored ones.

    The trees are kept as records from a digest to the digests some levels
    below. Requests for leaves descend from the root by the digits of their
    rank and collect what stands beside their path, which is then walked in reverse.
    Requests that share a path travel as one row and a record has at most
    ``WIDTH`` children, so no group's size makes a row or a task large.

    Ids are integers. Null ids come first in their group, the null group before
    all others; repeated ids are ordered by leaf, and rows equal in both are
    interchangeable. Null and empty texts are fields like any other. An empty
    table gives no rows, and other columns are left out.
    """
    bad = F.lit(None).cast("string")
    if tampered is not None:
        bad = F.when(tampered, leaf_digest(*[(tampered_fields or {}).get(c, F.col(c)) for c in fields]))
    leaves = stored(docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(group_col).alias("grp"),
        leaf_digest(*[F.col(c) for c in fields]).alias("digest"), bad.alias("bad"),
    ), "manifest-leaves")
    placed = ordered_index(leaves, ["grp", "doc_id", "digest"], "idx")
    sizes = placed.groupBy("grp").agg(F.min("idx").alias("start"), F.count(F.lit(1)).alias("leaves"))
    trees = stored(ordered_index(stored(sizes, "manifest-groups"), ["grp"], "tree"), "manifest-trees")
    n_trees = trees.count()
    if not n_trees:
        return docs.sparkSession.createDataFrame([], RESULT)
    ranked = placed.join(trees.withColumnRenamed("grp", "of"), F.col("grp").eqNullSafe(F.col("of"))).withColumn(
        "rank", F.col("idx") - F.col("start")
    )
    # Leaves are requested as they are grouped: those of one record travel together.
    requests = stored(_grouped(ranked, "doc_id", "bad"), "manifest-requests")
    depths = grow(requests)
    subroots = depths[-1].select("tree", F.col("digest").alias("subroot"))
    tops = grow(_grouped(depths[-1].select(
        F.lit(TOP).cast("bigint").alias("tree"), F.col("tree").alias("rank"), F.lit(n_trees).cast("bigint").alias("leaves"), "digest"
    )))
    root = tops[-1].first()["digest"]

    front = tops[-1].select("tree", "seg", "leaves", "levels", "digest", F.array().cast("array<string>").alias("path"))
    front = descend(front, trees.select(F.lit(TOP).cast("bigint").alias("tree"), F.col("tree").alias("seg")), tops)
    # A leaf of the top tree is the root of the tree of that number.
    front = depths[-1].select("tree", "seg", "leaves", "levels", "digest").join(
        front.select(F.col("seg").alias("tree"), "path"), "tree"
    )
    front = descend(front, requests.select("tree", "seg"), depths, lowest=1).join(
        requests.select("tree", "seg", "rows"), ["tree", "seg"]
    )
    last = front.join(_known(depths[0]), ["digest", "levels"]).join(subroots, "tree")

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
        for row in _rows(batches):
            rungs, out = ladder(row["children"], row["levels"]), []
            for leaf in row["rows"]:
                at = leaf["rank"] % WIDTH
                path = [*row["path"], *beside(rungs, at)]
                pairs = [path[i] + path[i + 1] for i in range(0, len(path), 2)]
                digest = row["children"][at]
                out.append((
                    leaf["doc_id"], digest, row["subroot"], _h("".join(reversed(pairs))), fold(leaf["bad"] or digest, path)
                ))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), types)],
                names=["doc_id", "leaf", "subroot", "proof_sha256", "folded_root"],
            )

    proven = last.select("levels", "children", "rows", "path", "subroot").mapInArrow(prove, PROOFS)
    return proven.select(
        "doc_id", "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root",
        (F.col("folded_root") == F.lit(root)).alias("verified"),
    )


# The checksum is a fold over the bytes with the usual reflected table. A path entry
# starts with the side on which it stands.
MANIFEST_SQL = """
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8),
      lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) AS c
    FROM (SELECT unnest(range(256)) AS i))),
fields AS (
  SELECT doc_id, lang, n_chars,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') AS a,
    coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS b,
    coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') AS b_bad,
    coalesce(strlen(text) || ':' || text, '-') AS c,
    coalesce(xor(4294967295, list_reduce(
      list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda h: ('0x' || h)::BIGINT),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295)) % 7 = 0, FALSE) AS bad
  FROM documents, crc_table),
base AS (
  SELECT row_number() OVER () AS rid, doc_id, leaf, bad_leaf, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank
  FROM (SELECT *, sha256(a || b || c) AS leaf, sha256(a || CASE WHEN bad THEN b_bad ELSE b END || c) AS bad_leaf FROM fields)),
nodes AS (
  SELECT tree, 0 AS lvl, rank AS pos, leaf AS d, count(*) OVER (PARTITION BY tree) AS n FROM base
  UNION ALL
  SELECT tree, lvl + 1, pos // 2, sha256(string_agg(d, '' ORDER BY pos)), (n + 1) // 2
  FROM nodes WHERE n > 1 GROUP BY tree, lvl, pos // 2, n),
subroots AS (SELECT tree, d AS subroot FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS lvl, tree AS pos, subroot AS d, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 2, sha256(string_agg(d, '' ORDER BY pos)), (n + 1) // 2 FROM tops WHERE n > 1 GROUP BY lvl, pos // 2, n),
path AS (
  SELECT rid, l.lvl, CASE WHEN (rank >> l.lvl) & 1 = 1 THEN 'L' ELSE 'R' END || coalesce(s.d, '') AS entry
  FROM base JOIN (SELECT DISTINCT tree, lvl FROM nodes WHERE n > 1) l USING (tree)
  LEFT JOIN nodes s ON s.tree = base.tree AND s.lvl = l.lvl AND s.pos = xor(rank >> l.lvl, 1)
  UNION ALL
  SELECT rid, 1000 + l.lvl, CASE WHEN (tree >> l.lvl) & 1 = 1 THEN 'L' ELSE 'R' END || coalesce(s.d, '')
  FROM base CROSS JOIN (SELECT DISTINCT lvl FROM tops WHERE n > 1) l
  LEFT JOIN tops s ON s.lvl = l.lvl AND s.pos = xor(tree >> l.lvl, 1)),
paths AS (
  SELECT rid, list(entry ORDER BY lvl) AS entries, string_agg(entry[2:], '' ORDER BY lvl) AS siblings FROM path GROUP BY rid),
folded AS (
  SELECT base.*, coalesce(siblings, '') AS siblings, list_reduce(coalesce(entries, []),
    lambda a, s: sha256(CASE WHEN s[1] = 'L' THEN s[2:] || a ELSE a || s[2:] END), bad_leaf) AS folded_root
  FROM base LEFT JOIN paths USING (rid))
SELECT doc_id, leaf, subroot, root, sha256(siblings) AS proof_sha256, folded_root, folded_root = root AS verified
FROM folded JOIN subroots USING (tree), (SELECT d AS root FROM tops WHERE n = 1)
"""


@query("op13_merkle_manifest", MANIFEST_SQL)
def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest_proofs(
        table(spark, sf_dir, "documents"),
        tampered=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0,
        # One digit more than the column has room for.
        tampered_fields={"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1},
    )
