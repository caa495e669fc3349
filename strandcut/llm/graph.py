"""Connected components of links between documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandcut.llm.common import dropped, stored


def components(links: DataFrame) -> DataFrame:
    """``node, comp`` for every node of the links ``a, b``; ``comp`` is the component's smallest node.

    Alternating large-star and small-star steps: every node points its larger
    neighbours, then its smaller ones, to the smallest node it knows of. Steps
    grow with the logarithm of the longest path. Each step is written, so a
    lost executor repeats one step only.
    """
    edges = stored(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        last, edges = edges, stored(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        dropped(last)
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()
    )
