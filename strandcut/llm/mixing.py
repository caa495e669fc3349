"""Operator 3: mix sources to target weights by weighted fair queueing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandcut.llm.common import bits_for, carried, count_words, KEY_BITS, shuffle_key, stored
from strandcut.llm.registry import query, table

CHUNK_ROWS = 256
REPEATS = 3
SEED = 11


def source_targets(sizes: DataFrame, weights: Sequence[int], repeats: int = REPEATS) -> DataFrame:
    """Words each source shall give: its weight's share of all words, at most ``repeats`` times its own.

    ``sizes`` has one row per ``source`` with its ``source_size``. The share
    cut off from full sources goes to the others by weight. Sources in order of
    how soon they fill up: the first one that the level reached so far does not
    fill ends the search, so no loop is needed.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(by_name) - 1).withColumn(
        "weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    )
    cap = repeats * F.col("source_size")
    fills = Window.orderBy((cap / F.col("weight")).asc(), "rank")
    before, everyone = fills.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (
        F.sum("source_size").over(everyone) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    ) / (F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    found = ranked.withColumn("level", level).withColumn("at", F.row_number().over(fills))
    open_at = F.min(F.when(cap >= F.col("level") * F.col("weight"), F.struct("at", "level"))).over(everyone)
    return found.withColumn("open", open_at).select(
        "source", "rank", "weight", "source_size",
        F.when(F.col("at") < F.col("open.at"), cap.cast("double"))
        .otherwise(F.col("weight") * F.col("open.level")).alias("target"),
    )


def queue(
    docs: DataFrame, weights: Sequence[int] = (1, 2, 3), *, repeats: int = REPEATS, seed: int = SEED,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> tuple[DataFrame, DataFrame, int]:
    """The shuffled documents with their place in their source, and all queued copies in global order.

    First result: ``key, doc_id, source, rank, size, source_size, target,
    before`` (words of the source ahead of the document). Second: one row per
    copy served, ``rank, before, copy, finish, begin, words``: virtual finish
    time (words of the source so far, over its target), first word's place in
    the whole mix, and words taken. Third: the budget, all words together.
    """
    rows = stored(
        docs.select(
            F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
            count_words(F.col(text_col)).alias("size"),
            shuffle_key(F.lit(seed), F.col(id_col), F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias("key"),
        ),
        "mix-sizes",
    )
    count, budget = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    targets = source_targets(
        rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, repeats
    )
    # A source's documents in shuffled order; a hot source is cut by the leading bits of the key.
    chunk = F.shiftright("key", KEY_BITS - bits_for(count, CHUNK_ROWS))
    keyed = rows.join(targets, rows["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    keyed = keyed.withColumn("chunk", chunk)
    ahead = carried(keyed, ["rank"], "chunk", {"ahead": F.col("size")})
    inside = Window.partitionBy("rank", "chunk").orderBy("key", "doc_id", "size")
    placed = (
        keyed.join(ahead, ["rank", "chunk"])
        .withColumn(
            "before",
            F.col("ahead")
            + F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        )
        .drop("chunk", "ahead", "weight")
    )
    # Every pass over a source queues its documents again until the target is met.
    start = F.col("copy") * F.col("source_size") + F.col("before")
    copies = (
        placed.where("size > 0")
        .withColumn("copy", F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(repeats)])))
        .withColumn("take", F.least(F.col("size"), F.ceil("target") - start))
        .where("take > 0")
        .withColumn("finish", (start + F.col("take")) / F.col("target"))
    )
    # Global order of finish times: equal ranges of virtual time hold about equal words.
    spans = 1 << bits_for(count, CHUNK_ROWS)
    copies = copies.withColumn("span", F.least(F.floor(F.col("finish") * spans), F.lit(spans)))
    earlier = carried(copies, [], "span", {"earlier": F.col("take")})
    order = Window.partitionBy("span").orderBy("finish", "rank", "before", "copy")
    served = (
        copies.join(earlier, "span")
        .withColumn(
            "begin",
            F.col("earlier")
            + F.coalesce(F.sum("take").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        )
        .withColumn("words", F.greatest(F.lit(0), F.least(F.col("take"), F.lit(budget) - F.col("begin"))))
        .drop("span", "earlier", "take")
    )
    return placed, served, budget


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), **options) -> DataFrame:
    """Words of every document that the mix takes.

    Sources by code point (null is a source, last) weigh ``weights``, repeating.
    Documents wait in their source's queue in a repeatable shuffled order, are
    served in the global order of virtual finish times, and the line is cut
    where the budget ends; a source's queue ends in a part of a document, so
    that it meets its target. Null and empty texts have size 0 and give
    nothing. Equal rows are queued one after the other. Other columns of
    ``docs`` are left out; an empty table gives no rows.
    """
    placed, served, _ = queue(docs, weights, **options)
    kept = ["doc_id", "source", "size", "source_size", "target"]
    taken = served.groupBy("rank", "before").agg(
        *[F.first(c).alias(c) for c in kept], F.sum("words").cast("bigint").alias("taken")
    )
    # The rest was never queued: without words, or behind the end of the first pass.
    rest = placed.where((F.col("size") == 0) | (F.col("before") >= F.ceil("target")))
    return taken.select(*kept, "taken").unionByName(rest.select(*kept, F.lit(0).cast("bigint").alias("taken")))


def cut_after(text: Column, words: Column, size: Column) -> Column:
    """``text`` up to the end of its first ``words`` words; only one of more words (``size``) is taken apart."""
    parts = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), 0)
    return F.when(words < size, F.array_join(F.slice(parts, F.lit(1), words.cast("int")), "")).otherwise(text)


def mixed_documents(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), **options) -> DataFrame:
    """The mix itself: a row of ``docs`` for each copy taken, in no order; a part is cut after its last word.

    ``n_chars``, where there, follows. Rows equal in id and text count as one
    document queued several times, and one of them gives the other columns.
    """
    placed, served, _ = queue(docs, weights, **options)
    copies = served.where("words > 0").groupBy(F.col("key").alias("__key"), F.col("words").alias("__words")).agg(
        F.count(F.lit(1)).alias("__times"), F.max("size").alias("__size")
    )
    key = shuffle_key(
        F.lit(options.get("seed", SEED)), F.col("doc_id"), F.md5(F.coalesce(F.col("text"), F.lit("")))
    )
    taken = (
        docs.withColumn("__key", key).dropDuplicates(["__key"]).join(copies, "__key")
        .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times"))))
    )
    text = cut_after(F.col("text"), F.col("__words"), F.col("__size"))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return taken.withColumns(changed).select(*docs.columns)


@query("op3_mixing")
def mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source"
    )
