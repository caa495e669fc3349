"""Metric and decay queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandcut.functions import schedule
from strandcut.operators import metrics, sequences
from strandcut.plans.catalog.registry import is_separator, query, table

# Labelled documents as an evaluated set: quality is the human label, a text of
# 400 characters or more is predicted 1, its length gives the second logit.
PREDICTIONS_SQL = """
    (SELECT l.doc_id, quality AS y, CASE WHEN n_chars >= 400 THEN 1 ELSE 0 END AS p,
            0.0::DOUBLE AS z0, ((n_chars - 400) / 400.0)::DOUBLE AS z1
     FROM labels l JOIN documents d ON l.doc_id = d.doc_id)
"""
BATCHES_SQL = f"(SELECT *, (row_number() OVER (ORDER BY doc_id) - 1) // 64 AS batch_id FROM {PREDICTIONS_SQL})"
LOSS_SQL = """greatest(z0, z1) + ln(exp(z0 - greatest(z0, z1)) + exp(z1 - greatest(z0, z1)))
              - CASE WHEN y = 1 THEN z1 ELSE z0 END"""
WEIGHT_SQL = "CASE WHEN y = 1 THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(
        table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id"
    )
    return rows.select(
        "doc_id",
        F.col("quality").alias("y"),
        F.when(F.col("n_chars") >= 400, 1).otherwise(0).alias("p"),
        F.lit(0.0).alias("z0"),
        ((F.col("n_chars") - 400) / 400.0).alias("z1"),
    )


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.batch_ids(predictions(spark, sf_dir), "doc_id", 64)


@query(
    "confusion",
    f"""
    SELECT count(*) FILTER (WHERE y = 1 AND p = 1) AS tp, count(*) FILTER (WHERE y <> 1 AND p = 1) AS fp,
           count(*) FILTER (WHERE y = 1 AND p <> 1) AS fn, count(*) FILTER (WHERE y <> 1 AND p <> 1) AS tn
    FROM {PREDICTIONS_SQL}
    """,
)
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(predictions(spark, sf_dir), "y", "p")


@query("accuracy_rows", f"SELECT round(avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM {PREDICTIONS_SQL}")
def accuracy_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    acc = metrics.accuracy_rows(predictions(spark, sf_dir), "y", "p")
    return acc.withColumn("accuracy", F.round("accuracy", 6))


@query(
    "accuracy_batch_mean",
    f"""
    SELECT count(*) AS batches, round(avg(acc), 6) AS accuracy
    FROM (SELECT batch_id, avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END) AS acc FROM {BATCHES_SQL} GROUP BY 1)
    """,
)
def accuracy_batch_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    acc = metrics.accuracy_batch_mean(batches(spark, sf_dir), "y", "p", "batch_id")
    return acc.withColumn("accuracy", F.round("accuracy", 6))


def _rate_sql(name: str, other: str) -> str:
    return f"""
    SELECT coalesce(round(sum(CASE WHEN y = 1 AND p = 1 THEN 1.0 ELSE 0.0 END)
                    / nullif(sum(CASE WHEN {other} = 1 THEN 1.0 ELSE 0.0 END), 0), 6), 0.0)::DOUBLE AS {name}
    FROM {PREDICTIONS_SQL}
    """


@query("recall", _rate_sql("recall", "y"))
def recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.recall(predictions(spark, sf_dir), "y", "p").withColumn("recall", F.round("recall", 6))


@query("precision", _rate_sql('"precision"', "p"))
def precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.precision(predictions(spark, sf_dir), "y", "p").withColumn("precision", F.round("precision", 6))


@query(
    "weighted_ce",
    f"SELECT round(sum({WEIGHT_SQL} * ({LOSS_SQL})) / sum({WEIGHT_SQL}), 5) AS loss FROM {PREDICTIONS_SQL}",
)
def weighted_ce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.weighted_ce(predictions(spark, sf_dir), "y", "z0", "z1").withColumn("loss", F.round("loss", 5))


@query(
    "loss_batch_mean",
    f"""
    SELECT count(*) AS batches, round(avg(loss), 5) AS loss
    FROM (SELECT batch_id, sum({WEIGHT_SQL} * ({LOSS_SQL})) / sum({WEIGHT_SQL}) AS loss FROM {BATCHES_SQL} GROUP BY 1)
    """,
)
def loss_batch_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = metrics.loss_batch_mean(batches(spark, sf_dir), "y", "z0", "z1", "batch_id")
    return mean.withColumn("loss", F.round("loss", 5))


@query(
    "metric_long",
    f"""
    WITH c AS (SELECT count(*) FILTER (WHERE y = p)::DOUBLE AS same, count(*)::DOUBLE AS n,
                      count(*) FILTER (WHERE y = 1 AND p = 1)::DOUBLE AS tp,
                      count(*) FILTER (WHERE y = 1)::DOUBLE AS pos FROM {PREDICTIONS_SQL}),
         l AS (SELECT sum({WEIGHT_SQL} * ({LOSS_SQL})) / sum({WEIGHT_SQL}) AS loss FROM {PREDICTIONS_SQL})
    SELECT 'eval/acc' AS tag, 0::BIGINT AS step, round(same / n, 5) AS value FROM c
    UNION ALL SELECT 'eval/loss', 0, round(loss, 5) FROM l
    UNION ALL SELECT 'eval/recall', 0, round(tp / pos, 5) FROM c
    """,
)
def metric_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All scalars of one evaluation from a single pass over the scored rows."""
    rows = predictions(spark, sf_dir)
    w = F.when(F.col("y") == 1, metrics.SLICE_WEIGHTS[1]).otherwise(metrics.SLICE_WEIGHTS[0])
    loss = metrics.cross_entropy(F.col("z0"), F.col("z1"), F.col("y"))
    hit, said = F.col("y") == 1, F.col("p") == 1
    summary = rows.agg(
        F.count_if(hit & said).alias("tp"), F.count_if(~hit & said).alias("fp"),
        F.count_if(hit & ~said).alias("fn"), F.count_if(~hit & ~said).alias("tn"),
        (F.sum(w * loss) / F.sum(w)).alias("loss"),
    )
    tags = {"accuracy": "eval/acc", "loss": "eval/loss", "recall": "eval/recall"}
    return metrics.metric_long(metrics.rates(summary), F.lit(0), tags).withColumn("value", F.round("value", 5))


# Events as epochs of scored rows: the day is the epoch.
DAYS_SQL = """
    (SELECT date_diff('day', TIMESTAMP '2024-01-01', ts) AS epoch, value AS loss,
            CASE WHEN event_type IN ('view', 'click', 'signup') THEN 0 ELSE 1 END AS y,
            CASE WHEN value >= 20 THEN 1 ELSE 0 END AS p FROM events)
"""


def daily_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.expr("timestampdiff(DAY, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts)").cast("bigint")
    return table(spark, sf_dir, "events").select(
        day.alias("epoch"),
        F.col("value").alias("loss"),
        is_separator().alias("y"),
        F.when(F.col("value") >= 20, 1).otherwise(0).alias("p"),
    )


@query(
    "epoch_summary",
    f"""
    SELECT epoch, count(*) AS n, round(avg(loss), 4) AS loss,
           round(count(*) FILTER (WHERE y = p) / count(*)::DOUBLE, 5) AS accuracy,
           round(count(*) FILTER (WHERE y = 1 AND p = 1) / (count(*) FILTER (WHERE y = 1))::DOUBLE, 5) AS recall,
           round(count(*) FILTER (WHERE y = 1 AND p = 1) / (count(*) FILTER (WHERE p = 1))::DOUBLE, 5) AS "precision"
    FROM {DAYS_SQL} GROUP BY epoch
    """,
)
def epoch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = metrics.epoch_summary(daily_rows(spark, sf_dir), "epoch", "y", "p", "loss")
    digits = {"loss": 4, "accuracy": 5, "recall": 5, "precision": 5}
    return summary.withColumns({c: F.round(c, d) for c, d in digits.items()})


@query(
    "running_mean",
    f"""
    SELECT epoch, round(avg(acc) OVER (ORDER BY epoch), 6) AS avg_acc
    FROM (SELECT epoch, avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END) AS acc FROM {DAYS_SQL} GROUP BY epoch)
    """,
)
def running_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = daily_rows(spark, sf_dir).groupBy("epoch").agg(
        F.avg((F.col("y") == F.col("p")).cast("double")).alias("acc")
    )
    means = sequences.running_mean(daily, "epoch", F.col("acc"), "avg_acc")
    return means.select("epoch", F.round("avg_acc", 6).alias("avg_acc"))


def epoch_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_rows(spark, sf_dir).groupBy("epoch").agg(F.count(F.lit(1)).alias("n"))


@query(
    "cosine_decay",
    f"""
    SELECT epoch, count(*) AS n, round(0.01 * 0.5 * (1 + cos(pi() * epoch / 21.0)), 8) AS rate
    FROM {DAYS_SQL} GROUP BY epoch
    """,
)
def cosine_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = F.round(schedule.cosine_decay(F.col("epoch"), 0.01, 21), 8)
    return epoch_days(spark, sf_dir).withColumn("rate", rate)


@query(
    "milestone_decay",
    f"""
    SELECT epoch, count(*) AS n, round(0.01 * power(0.1, (epoch >= 5)::INT + (epoch >= 20)::INT + (epoch >= 50)::INT
                                       + (epoch >= 100)::INT + (epoch >= 120)::INT), 8) AS rate
    FROM {DAYS_SQL} GROUP BY epoch
    """,
)
def milestone_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Fixed milestones of the default job.
    rate = F.round(schedule.milestone_decay(F.col("epoch"), 0.01, [5, 20, 50, 100, 120]), 8)
    return epoch_days(spark, sf_dir).withColumn("rate", rate)
