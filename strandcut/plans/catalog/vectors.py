"""Picture, scoring and embedding queries over the embedding vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandcut.functions import schedule
from strandcut.functions import vectors as V
from strandcut.operators import contrast, metrics, sampling, scoring, sequences, training
from strandcut.plans import prepare
from strandcut.plans.catalog.registry import SEED, query, table

VECTORS_SQL = "(SELECT vec_id, label, embedding::DOUBLE[] AS vec FROM embeddings)"


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", V.doubles(F.col("embedding")).alias("vec")
    )


def long_form(df: DataFrame, keys: list[str], vec: Column, digits: int) -> DataFrame:
    # The plain form would add a filter on the array, and so score it twice.
    rows = df.select(*keys, F.posexplode_outer(vec).alias("i", "x"))
    return rows.withColumn("x", F.round("x", digits))


def long_sql(keys: str, vec: str, source: str, digits: int) -> str:
    return f"""
    SELECT {keys}, i::INTEGER AS i, round(v[i + 1], {digits}) AS x
    FROM (SELECT {keys}, v, unnest(range(len(v))) AS i FROM (SELECT {keys}, {vec} AS v FROM {source}))
    """


@query("normalise", long_sql("vec_id", "list_transform(vec, lambda x: (x - 0.485) / 0.229)", VECTORS_SQL, 5))
def normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_form(embeddings(spark, sf_dir), ["vec_id"], V.normalise(F.col("vec")), 5)


@query(
    "l2_normalise",
    long_sql(
        "vec_id",
        "list_transform(vec, lambda x: x / sqrt(list_sum(list_transform(vec, lambda y: y * y))))",
        VECTORS_SQL, 5,
    ),
)
def l2_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_form(embeddings(spark, sf_dir), ["vec_id"], V.l2_normalise(F.col("vec")), 5)


FLIP_SQL = "CASE WHEN substr(md5('42:' || vec_id), 1, 1) < '8' THEN list_reverse(vec) ELSE vec END"


@query("random_flip", long_sql("vec_id", FLIP_SQL, VECTORS_SQL, 5))
def random_flip(spark: SparkSession, sf_dir: str) -> DataFrame:
    flipped = contrast.random_flip(embeddings(spark, sf_dir), "vec_id", "vec", SEED)
    return long_form(flipped, ["vec_id"], F.col("vec"), 5)


@query(
    "two_views",
    long_sql(
        "vec_id, view_no",
        "CASE WHEN substr(md5('42:' || vec_id || ':' || view_no), 1, 1) < '8' THEN list_reverse(vec) ELSE vec END",
        f"(SELECT *, unnest([0, 1])::INTEGER AS view_no FROM {VECTORS_SQL})", 5,
    ),
)
def two_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = contrast.two_views(embeddings(spark, sf_dir), "vec_id", "vec", SEED)
    return long_form(views, ["vec_id", "view_no"], F.col("vec"), 5)


# As pictures, the 64 numbers are 4 rows of 16.
WIDTH = 16


@query(
    "mark_centre",
    long_sql("vec_id", "list_transform(vec, lambda x, j: CASE WHEN (j - 1) % 16 = 8 THEN 0 ELSE x END)", VECTORS_SQL, 5),
)
def mark_centre(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_form(embeddings(spark, sf_dir), ["vec_id"], V.mark_centre(F.col("vec"), WIDTH), 5)


@query(
    "draw_cuts",
    long_sql(
        "vec_id",
        "list_transform(vec, lambda x, j: CASE WHEN (j - 1) % 16 = label OR (j - 1) % 16 = label + 5 THEN 0 ELSE x END)",
        VECTORS_SQL, 5,
    ),
)
def draw_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two cut columns per picture, kept in a table of their own and joined in."""
    pictures = embeddings(spark, sf_dir)
    cuts = pictures.select("vec_id", F.explode(F.array(F.col("label"), F.col("label") + 5)).alias("x"))
    per_picture = cuts.groupBy("vec_id").agg(F.collect_set("x").alias("xs"))
    drawn = pictures.join(per_picture, "vec_id", "left")
    xs = F.coalesce("xs", F.array().cast("array<int>"))
    return long_form(drawn, ["vec_id"], V.draw_columns(F.col("vec"), xs, WIDTH), 5)


def weights(outputs: int, inputs: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Stand-in parameters that SQL can work out too; the bias is a further column."""
    rows, cols = np.arange(outputs)[:, None], np.arange(inputs + 1)[None, :]
    grid = np.sin(rows * 31.0 + cols) / scale
    return grid[:, :-1], grid[:, -1]


def layer_sql(x: str, outputs: int, inputs: int, scale: float) -> str:
    return (
        f"list_transform(range({outputs}), lambda r: list_dot_product({x}, "
        f"list_transform(range({inputs}), lambda c: sin(r * 31.0 + c) / {scale})) "
        f"+ sin(r * 31.0 + {inputs}) / {scale})"
    )


LINEAR_SQL = f"(SELECT vec_id, {layer_sql('vec', 3, 64, 8.0)} AS z FROM {VECTORS_SQL})"


def linear_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = scoring.linear_model(*weights(3, 64, 8.0))
    return scoring.score_slices(embeddings(spark, sf_dir), ["vec"], [64], model)


@query(
    "score_linear",
    f"SELECT vec_id, round(z[1], 4) AS s0, round(z[2], 4) AS s1, round(z[3], 4) AS s2 FROM {LINEAR_SQL}",
)
def score_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = linear_scores(spark, sf_dir)
    return scored.select("vec_id", *[F.round(F.get("scores", F.lit(i)), 4).alias(f"s{i}") for i in range(3)])


@query(
    "argmax_label",
    f"SELECT vec_id, (list_position(z, list_max(z)) - 1)::INTEGER AS predicted FROM {LINEAR_SQL}",
)
def argmax_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.label_slices(linear_scores(spark, sf_dir), out="predicted").select("vec_id", "predicted")


@query(
    "evaluation_log",
    f"""
    WITH r AS (
      SELECT (row_number() OVER (ORDER BY vec_id) - 1) // 64 AS batch, label = 3 AS y, z[2] > z[1] AS said,
             CASE WHEN label = 3 THEN 0.7 ELSE 0.3 END AS c,
             ln(exp(z[1]) + exp(z[2])) - CASE WHEN label = 3 THEN z[2] ELSE z[1] END AS loss
      FROM {LINEAR_SQL} JOIN embeddings USING (vec_id)),
    b AS (SELECT sum(c * loss) / sum(c) AS loss, avg((y = said)::INT) AS acc FROM r GROUP BY batch),
    c AS (SELECT count(*) FILTER (y AND said) AS tp, count(*) FILTER (said) AS p, count(*) FILTER (y) AS h FROM r)
    SELECT unnest(['eval/acc', 'eval/loss', 'eval/recall', 'eval/precision']) AS tag, 7::BIGINT AS step,
           round(unnest([avg(acc), avg(loss), (SELECT CASE WHEN h = 0 THEN 0.0 ELSE tp / h END FROM c),
                         (SELECT CASE WHEN p = 0 THEN 0.0 ELSE tp / p END FROM c)]), 4) AS value
    FROM b
    """,
)
def evaluation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one evaluation logs: batch means of weighted loss and accuracy, recall and precision of all."""
    scored = linear_scores(spark, sf_dir).withColumns({
        "z0": F.get("scores", F.lit(0)), "z1": F.get("scores", F.lit(1)), "y": (F.col("label") == 3).cast("int"),
    }).withColumn("predicted", (F.col("z1") > F.col("z0")).cast("int"))
    logged = prepare.evaluation(scored, "y", 7, order="vec_id", size=64)
    return logged.withColumn("value", F.round("value", 4))


MLP_SQL = f"""
    SELECT vec_id, {layer_sql('h2', 2, 16, 4.0)} AS z FROM (
        SELECT vec_id, list_transform({layer_sql('h1', 16, 32, 4.0)}, lambda y: greatest(y, 0.0)) AS h2 FROM (
            SELECT vec_id, list_transform({layer_sql('vec', 32, 64, 4.0)}, lambda y: greatest(y, 0.0)) AS h1
            FROM {VECTORS_SQL}))
"""


@query("mlp_head", f"SELECT vec_id, round(z[1], 4) AS z0, round(z[2], 4) AS z1 FROM ({MLP_SQL})")
def mlp_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    layers = [weights(32, 64, 4.0), weights(16, 32, 4.0), weights(2, 16, 4.0)]
    scored = scoring.score_slices(embeddings(spark, sf_dir), ["vec"], [64], scoring.mlp_head(layers))
    return scored.select("vec_id", *[F.round(F.get("scores", F.lit(i)), 4).alias(f"z{i}") for i in range(2)])


def encoded_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query ``q`` and key ``k``: a vector and its randomly flipped view."""
    rows = embeddings(spark, sf_dir).withColumnRenamed("vec", "q")
    return contrast.random_flip(rows.withColumn("k", F.col("q")), "vec_id", "k", SEED)


PAIRS_SQL = f"(SELECT vec_id, vec AS q, {FLIP_SQL} AS k FROM {VECTORS_SQL})"


@query(
    "gated_fusion",
    long_sql(
        "vec_id",
        "list_transform(range(64), lambda j: k[j + 1] / (1 + exp(-g[1])) + q[j + 1] / (1 + exp(-g[2])))",
        f"""(SELECT vec_id, k, q, {layer_sql('h', 2, 64, 4.0)} AS g
             FROM (SELECT vec_id, k, q, {layer_sql('list_concat(k, q)', 64, 128, 8.0)} AS h FROM {PAIRS_SQL}))""",
        4,
    ),
)
def gated_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = scoring.gated_fusion(weights(64, 128, 8.0), weights(2, 64, 4.0))
    fused = scoring.score_slices(encoded_pairs(spark, sf_dir), ["k", "q"], [64, 64], model, "fused")
    return long_form(fused, ["vec_id"], F.col("fused"), 4)


@query("positive_logit", f"SELECT vec_id, round(list_dot_product(q, k), 5) AS l_pos FROM {PAIRS_SQL}")
def positive_logit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = contrast.positive_logit(encoded_pairs(spark, sf_dir), "q", "k")
    return pairs.select("vec_id", F.round("l_pos", 5).alias("l_pos"))


@query(
    "key_bank",
    "SELECT vec_id, vec_id % 65536 AS slot FROM embeddings ORDER BY vec_id DESC LIMIT 65536",
)
def key_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contrast.key_bank(table(spark, sf_dir, "embeddings").select("vec_id"), "vec_id")


@query("key_bank_cut", "SELECT vec_id, vec_id % 64 AS slot FROM embeddings ORDER BY vec_id DESC LIMIT 64")
def key_bank_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bank that has been overwritten several times."""
    return contrast.key_bank(table(spark, sf_dir, "embeddings").select("vec_id"), "vec_id", 64)


def bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = contrast.key_bank(embeddings(spark, sf_dir), "vec_id")
    return contrast.bank_places(keys, "vec")


BANK_SQL = f"(SELECT vec FROM {VECTORS_SQL} ORDER BY vec_id DESC LIMIT 65536)"
LOGITS_SQL = f"""
    (SELECT vec_id, list_dot_product(q, k) / 0.07 AS pos, list_dot_product(q, vec) / 0.07 AS neg
     FROM {PAIRS_SQL}, {BANK_SQL})
"""


@query(
    "contrastive_logits",
    f"""
    SELECT vec_id, count(*) + 1 AS n_logits, round(max(pos), 4) AS l_pos, round(max(neg), 4) AS neg_max,
           round(sum(neg), 3) AS neg_sum
    FROM {LOGITS_SQL} GROUP BY vec_id
    """,
)
def contrastive_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = contrast.contrastive_logits(encoded_pairs(spark, sf_dir), "vec_id", "q", "k", bank(spark, sf_dir))
    return rows.select(
        "vec_id", (F.col("n_keys") + 1).alias("n_logits"), F.round("l_pos", 4).alias("l_pos"),
        F.round("neg_max", 4).alias("neg_max"), F.round("neg_sum", 3).alias("neg_sum"),
    )


@query(
    "info_nce",
    f"""
    SELECT vec_id, round(ln(sum(exp(neg - top)) + exp(max(pos) - max(top))) + max(top) - max(pos), 4) AS loss
    FROM (SELECT *, greatest(pos, max(neg) OVER (PARTITION BY vec_id)) AS top FROM {LOGITS_SQL})
    GROUP BY vec_id
    """,
)
def info_nce(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = contrast.info_nce(encoded_pairs(spark, sf_dir), "vec_id", "q", "k", bank(spark, sf_dir))
    return rows.select("vec_id", F.round("loss", 4).alias("loss"))


# Row r is in batch r // 32 and sees the keys of the 64 rows before its batch.
STEP_SQL = f"""
    SELECT a.vec_id, a.rank // 32 AS batch_id, a.rank % 64 AS slot, count(b.rank) AS n_keys,
           list_dot_product(any_value(a.q), any_value(a.k)) / 0.07 AS pos,
           max(list_dot_product(a.q, b.k)) / 0.07 AS top, list(list_dot_product(a.q, b.k) / 0.07) FILTER (b.rank IS NOT NULL) AS negs
    FROM (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS rank FROM {PAIRS_SQL}) a
    LEFT JOIN (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS rank FROM {PAIRS_SQL}) b
      ON b.rank >= a.rank // 32 * 32 - 64 AND b.rank < a.rank // 32 * 32
    GROUP BY a.vec_id, a.rank
"""


@query(
    "bank_by_step",
    f"""
    SELECT vec_id, batch_id, slot, n_keys, round(pos, 4) AS l_pos, round(top, 4) AS neg_max,
           round(coalesce(list_sum(negs), 0.0), 3) AS neg_sum,
           round(greatest(pos, coalesce(top, pos))
             + ln(exp(pos - greatest(pos, coalesce(top, pos)))
                  + coalesce(list_sum(list_transform(negs, lambda z: exp(z - greatest(pos, top)))), 0)) - pos, 4) AS loss
    FROM ({STEP_SQL})
    """,
)
def bank_by_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 32 against a ring of 64 keys, as it stood before each of them; blocks of 48 keys cut every window."""
    rows = contrast.bank_by_step(
        encoded_pairs(spark, sf_dir), "vec_id", "q", "k", batch=32, size=64, key_rows=48, query_rows=64
    )
    return rows.select(
        "vec_id", "batch_id", "slot", "n_keys", *[F.round(c, 4).alias(c) for c in ("l_pos", "neg_max")],
        F.round("neg_sum", 3).alias("neg_sum"), F.round("loss", 4).alias("loss"),
    )


CONTEXT_SQL = f"""
    (SELECT vec_id, list_concat(list_concat(coalesce(lag(vec) OVER w, z), vec), coalesce(lead(vec) OVER w, z)) AS vec
     FROM (SELECT *, list_transform(range(64), lambda j: 0.0::DOUBLE) AS z FROM {VECTORS_SQL})
     WINDOW w AS (PARTITION BY label ORDER BY vec_id))
"""


@query("context_vectors", long_sql("vec_id", "vec", CONTEXT_SQL, 5))
def context_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of one label, in order of their number, as the slices of a line."""
    seen = sequences.context_vectors(embeddings(spark, sf_dir), "label", "vec_id", "vec", 64)
    return long_form(seen, ["vec_id"], F.col("context"), 5)


@query(
    "sequence_head",
    f"""
    SELECT vec_id, round(z[1], 4) AS z0, round(z[2], 4) AS z1 FROM (
        SELECT vec_id, {layer_sql('h2', 2, 16, 4.0)} AS z FROM (
            SELECT vec_id, list_transform({layer_sql('h1', 16, 64, 8.0)}, lambda y: greatest(y, 0.0)) AS h2 FROM (
                SELECT vec_id, list_transform({layer_sql('vec', 64, 192, 8.0)}, lambda y: greatest(y, 0.0)) AS h1
                FROM {CONTEXT_SQL})))
    """,
)
def sequence_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classifier head of the sequence variant on vectors with their neighbours."""
    seen = sequences.context_vectors(embeddings(spark, sf_dir), "label", "vec_id", "vec", 64)
    layers = [weights(64, 192, 8.0), weights(16, 64, 8.0), weights(2, 16, 4.0)]
    scored = scoring.score_slices(seen, ["context"], [192], scoring.mlp_head(layers))
    return scored.select("vec_id", *[F.round(F.get("scores", F.lit(i)), 4).alias(f"z{i}") for i in range(2)])


@query(
    "train_epochs",
    """
    WITH RECURSIVE d AS (
      SELECT embedding::DOUBLE[] || [1.0::DOUBLE] AS x, label = 3 AS y, vec_id % 3 = 0 AS test,
             CASE WHEN label = 3 THEN 1.0 ELSE 0.5 END AS c FROM embeddings),
    steps AS (
      SELECT 0::BIGINT AS epoch, list_transform(range(65), lambda i: 0.0::DOUBLE) AS w
      UNION ALL
      SELECT epoch + 1, list(wi - rate * g ORDER BY i) FROM (
        SELECT epoch, i, any_value(w[i]) AS wi, 2.0 * (1 + cos(pi() * epoch / 4.0)) AS rate,
               sum(c * (p - y::INT) * x[i]) / sum(c) AS g
        FROM (SELECT s.epoch, s.w, d.x, d.y, d.c, 1 / (1 + exp(-list_dot_product(d.x, s.w))) AS p
              FROM steps s, d WHERE NOT d.test AND s.epoch < 4) AS scored, unnest(range(1, 66)) AS places(i)
        GROUP BY epoch, i) GROUP BY epoch, rate),
    z AS (SELECT epoch, w, test, y, c, list_dot_product(x, w) AS z FROM steps, d),
    sums AS (
      SELECT epoch, any_value(w) AS w,
        sum(c * ln(1 + exp(CASE WHEN y THEN -z ELSE z END))) FILTER (NOT test) / sum(c) FILTER (NOT test) AS loss,
        sum(c * ln(1 + exp(CASE WHEN y THEN -z ELSE z END))) FILTER (test) / sum(c) FILTER (test) AS eval_loss,
        count(*) FILTER (test AND z > 0 AND y) AS tp, count(*) FILTER (test AND z > 0 AND NOT y) AS fp,
        count(*) FILTER (test AND z <= 0 AND y) AS fn, count(*) FILTER (test AND z <= 0 AND NOT y) AS tn
      FROM z GROUP BY epoch)
    SELECT epoch, round(2.0 * (1 + cos(pi() * epoch / 4.0)), 5) AS rate, round(loss, 5) AS loss, round(eval_loss, 5) AS eval_loss,
           tp, fp, fn, tn, round(w[1], 5) AS first, round(w[65], 5) AS bias
    FROM sums
    """,
)
def train_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four steps of falling size on two thirds of the vectors, judged on the others after each."""
    rows = embeddings(spark, sf_dir).withColumns({"y": (F.col("label") == 3).cast("int"), "test": F.col("vec_id") % 3 == 0})
    steps = training.train_epochs(
        rows, "vec", "y", "test", width=64, epochs=4, rate=lambda e: schedule.cosine_decay(e, 4.0, 4), class_weights=(0.5, 1.0)
    )
    rounded = [F.round(c, 5).alias(c) for c in ("rate", "loss", "eval_loss")]
    return steps.select(
        "epoch", *rounded, *training.COUNTS,
        F.round(F.get("weights", F.lit(0)), 5).alias("first"), F.round(F.get("weights", F.lit(64)), 5).alias("bias"),
    )


@query("fit_classifier")
def fit_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit on the train part, report on the test part (no SQL twin: iterative)."""
    rows = embeddings(spark, sf_dir).withColumn("y", (F.col("label") == 3).cast("int"))
    split = sampling.train_test_split(rows, "vec_id", 0.3, SEED)
    model = scoring.train_slice_classifier(split.where(~F.col("is_test")), "vec", "y")
    scored = scoring.classify(model, split.where("is_test"), "vec")
    return metrics.rates(metrics.confusion(scored, "y", "predicted"))
