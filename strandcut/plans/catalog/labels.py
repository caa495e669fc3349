"""Label notation, label joins, checks, splits and path queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandcut.functions import names
from strandcut.operators import labelling, sampling
from strandcut.plans.catalog.registry import EVENTS_SQL, SEED, labelled_events, query, table
from strandcut.sources.tables import stage_manifest as stage_paths

# Label rows written from order numbers: n is the index, m a small offset, the
# form is one of eight by order number; form 7 is malformed. The SQL side works
# the answer out from n, m and the form and reads no notation.
SPECS_SQL = """
    (SELECT o_orderkey, o_orderkey % 8 AS form, o_orderkey % 1000 AS n, o_custkey % 5 AS m FROM orders)
"""


def order_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    form, n, m = F.col("o_orderkey") % 8, F.col("o_orderkey") % 1000, F.col("o_custkey") % 5
    tail = (
        F.when(form == 0, "").when(form == 1, "+").when(form == 2, "++").when(form == 3, F.concat(F.lit("+"), m))
        .when(form == 4, F.concat(F.lit("-"), n + m)).when(form == 5, "*").when(form == 6, "+*").otherwise("*+")
    )
    raw = F.concat(F.lit("\t"), n, tail, F.lit("\t"))
    return table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw"))


def clean_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelling.clean_label_lines(order_specs(spark, sf_dir), "raw").select("o_orderkey", "spec")


@query(
    "label_expand",
    f"""
    SELECT o_orderkey, (n + unnest(range(extra + 1)))::BIGINT AS idx
    FROM (SELECT *, CASE form WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN m WHEN 4 THEN m WHEN 6 THEN 1 ELSE 0 END AS extra
          FROM {SPECS_SQL} WHERE form <> 7)
    """,
)
def label_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The well-formed rows; the others are those of ``label_errors``."""
    return labelling.expand_labels(clean_specs(spark, sf_dir), "spec", strict=False).select("o_orderkey", "idx")


@query(
    "label_flag",
    f"""
    SELECT form IN (5, 6) AS import_flag, count(*) AS n_rows, min(o_orderkey) AS first_key
    FROM {SPECS_SQL}, (SELECT unnest(range(5)) AS k)
    WHERE form <> 7 AND k <= CASE form WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN m WHEN 4 THEN m WHEN 6 THEN 1 ELSE 0 END
    GROUP BY 1
    """,
)
def label_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    expanded = labelling.expand_labels(clean_specs(spark, sf_dir), "spec", strict=False)
    return expanded.groupBy("import_flag").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("o_orderkey").alias("first_key")
    )


@query(
    "label_errors",
    f"SELECT o_orderkey, n || '*+' AS spec, 'symbol_order' AS error FROM {SPECS_SQL} WHERE form = 7",
)
def label_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelling.label_errors(clean_specs(spark, sf_dir), "spec")


@query(
    "apply_labels",
    """
    SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 0 ELSE 1 END AS image_type,
           coalesce(l.toxic = 1, false) AS import_flag
    FROM documents d LEFT JOIN (SELECT * FROM labels WHERE quality = 1) l ON d.doc_id = l.doc_id
    """,
)
def apply_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = table(spark, sf_dir, "labels").where(F.col("quality") == 1)
    flags = marks.select("doc_id", F.col("doc_id").alias("line_at"), (F.col("toxic") == 1).alias("import_flag"))
    slices = table(spark, sf_dir, "documents").select("doc_id")
    return labelling.apply_labels(slices, labelling.last_flags(flags, ["doc_id"]), "doc_id")


@query(
    "label_out_of_range",
    f"""
    SELECT user_id, idx FROM (SELECT DISTINCT user_id, floor(value)::BIGINT AS idx FROM events)
    ANTI JOIN (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx
               FROM {EVENTS_SQL}) USING (user_id, idx)
    """,
)
def label_out_of_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = labelled_events(spark, sf_dir)
    marks = table(spark, sf_dir, "events").select("user_id", F.floor("value").alias("idx")).distinct()
    counts = events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return labelling.label_out_of_range(marks, counts, "user_id", "idx", "n")


@query(
    "missing_labels",
    "SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
)
def missing_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return labelling.missing_labels(items, table(spark, sf_dir, "labels"), "doc_id")


@query(
    "clean_lines",
    """
    SELECT doc_id, count(*) AS n_lines, sum(length(line))::BIGINT AS chars
    FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10))), chr(9)) AS line FROM documents)
    WHERE line <> '' GROUP BY doc_id
    """,
)
def clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("raw"))
    cleaned = labelling.clean_label_lines(rows, "raw")
    return cleaned.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("spec").cast("bigint")).alias("chars")
    )


@query(
    "dense_index",
    """
    SELECT l_orderkey, idx, count(*) AS n_rows, count(*) FILTER (WHERE place <> idx) AS n_bad
    FROM (SELECT l_orderkey, (l_linenumber - 1)::BIGINT AS idx,
                 row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS place
          FROM lineitem)
    GROUP BY 1, 2 HAVING n_bad > 0
    """,
)
def dense_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    numbered = rows.select("l_orderkey", (F.col("l_linenumber") - 1).cast("bigint").alias("idx"))
    return labelling.dense_index_violations(numbered, "l_orderkey", "idx")


@query(
    "parse_name",
    """
    SELECT c_custkey, c_name AS name, NULL::BIGINT AS idx, NULL::INTEGER AS image_type FROM customer
    UNION ALL
    SELECT c_custkey, printf('word_seg_%04d_type_%02d.png', c_custkey, c_nationkey), c_custkey, c_nationkey
    FROM customer
    """,
)
def parse_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slice names made from customers, next to their plain names, which do not parse."""
    made = names.slice_name(F.col("c_custkey"), F.col("c_nationkey"))
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", F.explode(F.array(F.col("c_name"), made)).alias("name")
    )
    return rows.withColumns(names.parse_number_pair(F.col("name")))


@query(
    "union_sources",
    """
    SELECT 'customer' AS kind, c_custkey AS key, c_name AS name, c_acctbal AS balance FROM customer
    UNION ALL SELECT 'supplier', s_suppkey, s_name, s_acctbal FROM supplier
    """,
)
def union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        table(spark, sf_dir, kind).select(
            F.lit(kind).alias("kind"),
            F.col(f"{p}key").alias("key"),
            F.col(f"{p[0]}_name").alias("name"),
            F.col(f"{p[0]}_acctbal").alias("balance"),
        )
        for kind, p in (("customer", "c_cust"), ("supplier", "s_supp"))
    ]
    return labelling.collect_all(parts)


@query(
    "stage_manifest",
    """
    SELECT page_id, 'src/' || host || '/sentence/' || page_id || '.html' AS path,
           'dst/' || host || '_' || page_id || '/' || page_id || '.html' AS target
    FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host FROM pages)
    """,
)
def stage_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1)
    path = F.concat(F.lit("src/"), host, F.lit("/sentence/"), F.col("page_id"), F.lit(".html"))
    return stage_paths(table(spark, sf_dir, "pages").select("page_id", path.alias("path")), "path", "dst")


RANKED_SQL = """
    (SELECT *, row_number() OVER (ORDER BY md5('42:' || doc_id)) AS rank, count(*) OVER () AS n FROM labels)
"""


@query(
    "train_test_split",
    f"SELECT doc_id, quality, toxic, rank <= ceil(round(n * 0.3, 6)) AS is_test FROM {RANKED_SQL}",
)
def train_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.train_test_split(table(spark, sf_dir, "labels"), "doc_id", 0.3, SEED)


@query(
    "oversample",
    """
    SELECT doc_id, quality, toxic, unnest(range(CASE WHEN toxic = 1 THEN 3 ELSE 1 END))::INTEGER AS copy_no
    FROM labels
    """,
)
def oversample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.oversample(table(spark, sf_dir, "labels"), F.col("toxic") == 1, 3)


@query("shuffle_order", f"SELECT doc_id, quality, toxic, (rank - 1)::BIGINT AS pos FROM {RANKED_SQL}")
def shuffle_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.shuffle_order(table(spark, sf_dir, "labels"), "doc_id", SEED)
