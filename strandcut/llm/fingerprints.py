"""Operator 8: I-Match fingerprints with several randomised lexicons."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandcut.llm.common import range_chunk
from strandcut.llm.registry import query, table

GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Document-frequency shares of the lexicon's terms. The lower one also bounds the
#: lexicon: it has at most (mean distinct terms of a document) / LOW terms.
LOW, HIGH = 0.002, 0.1
#: Lexicon subsets: FAMILIES independent draws, and in each one subset per level that keeps
#: a term with chance 2 ** -level, so that short and long texts alike have subsets of a few terms.
FAMILIES, LEVELS = 8, (3, 5, 7, 9, 11)
BUCKETS = 1_024
CHUNK_ROWS = 512


def distinct_terms(text: Column) -> Column:
    return F.array_remove(F.array_distinct(F.split(F.lower(text), GAP)), "")


def lexicon(docs: DataFrame, *, text_col: str = "text", low: float = LOW, high: float = HIGH) -> DataFrame:
    """64-bit hashes of the terms that stand in a share of ``low`` to ``high`` of all documents.

    A term must also stand in two documents, so that tiny tables have a lexicon.
    """
    n = docs.count()
    terms = docs.select(F.explode(distinct_terms(F.coalesce(F.col(text_col), F.lit("")))).alias("t"))
    counts = terms.select(F.xxhash64("t").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    return counts.where((F.col("df") >= max(2.0, low * n)) & (F.col("df") <= max(2.0, high * n))).select("h")


def lookup(lex: DataFrame, buckets: int = BUCKETS) -> Column:
    """The lexicon as a constant array of ``buckets`` small arrays.

    It goes to the driver and to all tasks; its size does not grow with the
    number of documents (see ``LOW``).
    """
    at: list[list[int]] = [[] for _ in range(buckets)]
    for row in lex.collect():
        at[row["h"] % buckets].append(row["h"])
    return F.from_json(F.lit(json.dumps([sorted(hs) for hs in at])), "array<array<bigint>>")


def kept_terms(terms: Column, lex: Column, buckets: int = BUCKETS) -> Column:
    """Hashes of the terms inside the lexicon, sorted."""
    hashes = F.transform(terms, lambda t: F.xxhash64(t))
    return F.array_sort(
        F.filter(hashes, lambda h: F.array_contains(F.get(lex, F.pmod(h, F.lit(buckets)).cast("int")), h))
    )


def signatures(kept: Column) -> Column:
    """One hash per lexicon subset; null where no kept term is in it.

    In a family, the subset of one level is drawn from that of the level before.
    """
    def hashed(terms: Column) -> Column:
        return F.when(F.size(terms) > 0, F.xxhash64(terms))

    def drawn(terms: Column, family: int, levels: tuple[int, ...]) -> Column:
        mask = (1 << levels[0]) - 1
        some = F.filter(terms, lambda h: F.xxhash64(h, F.lit(family)).bitwiseAND(F.lit(mask)) == 0)
        below = levels[1:]
        return F.transform(F.array(some), lambda s: (
            F.concat(F.array(hashed(s)), drawn(s, family, below)) if below else F.array(hashed(s))
        ))[0]

    return F.concat(F.array(hashed(kept)), *[drawn(kept, f, LEVELS) for f in range(FAMILIES)])


def as_text(signature: Column, whole: Column) -> Column:
    """Hex hashes joined by dots; a text without a kept term is its own fingerprint."""
    hexed = F.array_join(F.transform(signature, lambda s: F.coalesce(F.lower(F.hex(s)), F.lit("-"))), ".")
    return F.when(F.exists(signature, lambda s: s.isNotNull()), hexed).otherwise(
        F.concat(F.lit("="), F.lower(F.hex(whole)))
    )


def likeness(a: Column, b: Column, whole_a: Column, whole_b: Column) -> Column:
    """Share of equal hashes among the subsets that are not empty on both sides."""
    pairs = F.zip_with(a, b, lambda x, y: F.when(x.isNull() & y.isNull(), -1).otherwise((x.eqNullSafe(y)).cast("int")))
    used = F.filter(pairs, lambda v: v >= 0)
    same = F.size(F.filter(used, lambda v: v == 1))
    return F.when(F.size(used) > 0, same / F.size(used)).otherwise((whole_a == whole_b).cast("double"))


def fingerprint_edits(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", low: float = LOW, high: float = HIGH
) -> DataFrame:
    """Fingerprints of every text, of its edited text, and how alike they are.

    Terms of a middle document frequency over all of ``docs`` are the lexicon.
    A text's terms in it, sorted, are hashed once for every lexicon subset. The
    edited text ends in the beginning of the next text: that of the next
    smaller id (nulls last, equal ids by text), after the last that of the
    first. Texts are shuffled once, by chunks of the id; the head text of a
    chunk closes the gap to the chunk before, and fingerprints follow by the
    same window.

    Null text counts as empty. Texts without a lexicon term get a fingerprint
    of their own whole text. Equal texts have equal fingerprints. A single
    document is its own next one; an empty table gives no rows; repeated rows
    stay and other columns are left out.
    """
    lex = lookup(lexicon(docs, text_col=text_col, low=low, high=high))
    based = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cut = based.withColumn("cut", range_chunk(based, "doc_id", docs.count(), CHUNK_ROWS))
    inside = Window.partitionBy("cut").orderBy(F.col("doc_id").desc_nulls_last(), F.col("text").desc())
    led = cut.withColumns({"lead": F.lead("text").over(inside), "n": F.row_number().over(inside)})
    chunks = Window.orderBy(F.col("cut").desc())
    every = chunks.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # One text per chunk, at most 2 ** 12 of them.
    heads = led.where("n = 1").select(
        "cut", F.coalesce(F.lead("text").over(chunks), F.first("text").over(every)).alias("after")
    )
    texts = led.join(heads, "cut").withColumn("n_chars", F.length("text"))
    texts = texts.withColumn("edited", F.expr(
        "concat(left(text, n_chars - cast(floor(n_chars / 3) as int)),"
        " left(coalesce(lead, after), cast(floor(n_chars / 3) as int)))"
    ))
    # Own and edited text, and at the end of a chunk also the head of the next.
    sides = F.array(F.col("text"), F.col("edited"), F.when(F.col("lead").isNull(), F.col("after")))
    kept = texts.select(
        "cut", "doc_id", "text", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        F.transform(sides, lambda t: F.xxhash64(t)).alias("whole"),
        F.transform(sides, lambda t: F.when(t.isNotNull(), kept_terms(distinct_terms(t), lex))).alias("kept"),
    )
    signed = kept.withColumn("sigs", F.transform("kept", lambda k: F.when(k.isNotNull(), signatures(k)))).drop("kept")
    after = signed.select(
        "doc_id", F.col("n_chars").cast("bigint").alias("n_chars"), "edited_sha256", "sigs", "whole",
        F.coalesce(F.lead(F.col("sigs")[0]).over(inside), F.col("sigs")[2]).alias("next_sig"),
        F.coalesce(F.lead(F.col("whole")[0]).over(inside), F.col("whole")[2]).alias("next_whole"),
    )
    own, own_whole = F.col("sigs")[0], F.col("whole")[0]
    new, new_whole = F.col("sigs")[1], F.col("whole")[1]
    return after.select(
        "doc_id", "n_chars", "edited_sha256",
        as_text(own, own_whole).alias("fingerprint"), as_text(new, new_whole).alias("edited_fingerprint"),
        likeness(own, new, own_whole, new_whole).alias("near_edited"),
        likeness(own, F.col("next_sig"), own_whole, F.col("next_whole")).alias("near_next"),
    )


@query("op8_document_fingerprints")
def document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))
