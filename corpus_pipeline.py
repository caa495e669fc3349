"""From raw documents to token ids: five operators, one after the other."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandcut.llm import jaccard, mixing, pieces, pii, quality
from strandcut.llm.common import stored
from strandcut.llm.registry import table

#: Rows of an Arrow batch. Texts are wide, and a batch is held in the JVM and in the worker of each task; freed ones
#: of tens of MB stay with the process.
BATCH_ROWS = 512


def narrow_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches have ``BATCH_ROWS`` rows at most; a stage is run after it returns."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject."""
    narrow_batches(spark)
    judged = quality.judge(docs, table(spark, sf_dir, "labels"))
    return judged.where("keep").select(*docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest id, those without an id last.

    Words of five, similarity of 0.8. The decision is one about rows, known by id and
    text: another text of the same id is another document, and copies without an id are copies.
    Of rows of one id and text one stays. Documents without words are in no group and all stay.
    """
    narrow_batches(spark)
    # Two hashes of id and text, taken where the row is; no text moves to be told apart.
    marks = {"__row": F.xxhash64("doc_id", "text"), "__row2": F.xxhash64(F.lit(2), "text", "doc_id")}
    marked = docs.withColumns(marks)
    groups = stored(jaccard.jaccard_groups(marked, percent=80, width=5, also=list(marks)).where("component IS NOT NULL"), "pipeline-groups")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", *marks)
    first = stored(groups.groupBy("component").agg(F.min(order).alias("first")), "pipeline-first")
    same = reduce(lambda x, y: x & y, [F.col(m) == F.col("first")[m] for m in marks])
    lost = groups.join(first, "component").where(~same).select(*marks).distinct()
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    left = marked.where(worded).join(lost, list(marks), "left_anti").dropDuplicates(list(marks))
    return left.unionByName(marked.where(~worded)).select(*docs.columns)


def pii_masks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by the name of its kind."""
    narrow_batches(spark)
    return pii.mask_documents(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, each as often as it does; a part taken is cut after its words."""
    return mixing.mixed_documents(docs)


def sentencepiece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text of the mix, and the text decoded from them."""
    narrow_batches(spark)
    return pieces.encode_texts(docs, pieces.model_path())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("pii", pii_masks),
    ("mixing", mixing_sources),
    ("sentencepiece", sentencepiece_ids),
]

# A fitted classifier and a piece encoder cannot be said in SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
