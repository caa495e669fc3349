"""Slicing, spans, numbering, windows and review queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandcut.functions import geometry as G
from strandcut.functions import names
from strandcut.operators import metrics, review, sampling, sequences, slicing, spans
from strandcut.operators.ordering import chunk_of, number_copies, running_position
from strandcut.plans.catalog.registry import (
    EVENTS_SQL,
    is_separator,
    labelled_events,
    query,
    table,
)
from strandcut.session import shared_dir
from strandcut.streaming.landing import detect_stream, read_landing
from strandcut.streaming.runs import current_spans, track_runs

SPANS_SQL = f"""
    SELECT user_id, (g - 1)::BIGINT AS span_no,
           arg_min(coalesce(before, 0), event_id)::BIGINT AS beg,
           coalesce(min(event_id) FILTER (WHERE label <> 0), max(event_id))::BIGINT AS "end"
    FROM (
        SELECT *, sum(CASE WHEN label = 0 AND coalesce(was, 1) <> 0 THEN 1 ELSE 0 END)
                  OVER (PARTITION BY user_id ORDER BY event_id) AS g
        FROM (
            SELECT *, lag(label) OVER w AS was, lag(event_id) OVER w AS before
            FROM {EVENTS_SQL} WINDOW w AS (PARTITION BY user_id ORDER BY event_id)
        )
    )
    WHERE g > 0
    GROUP BY user_id, g
"""


@query("char_spans", SPANS_SQL)
def char_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.char_spans(labelled_events(spark, sf_dir), "user_id", "event_id", "label", "event_id")


@query("char_spans_cut", SPANS_SQL)
def char_spans_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same spans with every user of over 20 events cut into chunks."""
    rows = labelled_events(spark, sf_dir)
    return spans.char_spans(rows, "user_id", "event_id", "label", "event_id", bits=9, hot_rows=20)


@query("span_stream", SPANS_SQL)
def span_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same spans from a stream over the landed file."""
    schema = table(spark, sf_dir, "events").schema
    run = f"{shared_dir(spark)}/span_stream-{uuid.uuid4().hex}"
    stream = read_landing(spark, f"{sf_dir}/events*.parquet", schema)
    job = detect_stream(
        stream, "user_id", "event_id", "label", "event_id", f"{run}/spans", f"{run}/state",
        prepare=lambda batch: batch.select("user_id", "event_id", is_separator().alias("label")),
    )
    job.awaitTermination()
    return spark.read.parquet(f"{run}/spans").drop("batch")


@query("span_stream_state", SPANS_SQL)
def span_stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same spans where every user's events land over four files, older ones after newer ones.

    After each landing the stream takes up its state and works off the new file; chunks of 512
    event numbers cut the users.
    """
    run = f"{shared_dir(spark)}/span_stream_state-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", is_separator().alias("label"))
    for landing in range(4):
        rows.where(F.pmod(F.xxhash64("event_id"), F.lit(4)) == landing).write.mode("append").parquet(f"{run}/landed")
        stream = read_landing(spark, f"{run}/landed", rows.schema)
        track_runs(stream, "user_id", "event_id", "label", "event_id", f"{run}/runs", f"{run}/state", bits=9).awaitTermination()
    return current_spans(spark, f"{run}/runs", "user_id")


@query(
    "spans_json",
    f"""
    SELECT user_id, (span_no // 4096)::BIGINT AS page_no,
           md5('[' || string_agg('[' || beg || ',' || "end" || ']', ',' ORDER BY span_no) || ']') AS json_md5
    FROM ({SPANS_SQL}) GROUP BY 1, 2
    """,
)
def spans_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spans.spans_json(char_spans(spark, sf_dir), "user_id")
    return listed.select("user_id", "page_no", F.md5("spans_json").alias("json_md5"))


@query("cut_positions", f"SELECT user_id, event_id AS pos FROM {EVENTS_SQL} WHERE label = 1")
def cut_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled_events(spark, sf_dir).withColumn("pos", F.col("event_id"))
    return spans.cut_positions(rows, "label", ["user_id", "pos"])


NUMBERED_SQL = (
    f"(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx FROM {EVENTS_SQL})"
)


def numbered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return running_position(labelled_events(spark, sf_dir), "user_id", "event_id", "idx")


@query("predicted_index", f"SELECT user_id, idx::BIGINT AS idx FROM {NUMBERED_SQL} WHERE label = 1")
def predicted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.cut_positions(numbered_events(spark, sf_dir), "label", ["user_id", "idx"])


@query("dir_counts", f"SELECT user_id, count(*) FILTER (WHERE label = 1) AS n_predicted FROM {EVENTS_SQL} GROUP BY 1")
def dir_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.dir_counts(labelled_events(spark, sf_dir), "user_id", "label")


@query(
    "slice_name",
    f"SELECT user_id, printf('word_seg_%04d_type_%02d.png', idx, label) AS name FROM {NUMBERED_SQL}",
)
def slice_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = numbered_events(spark, sf_dir)
    return rows.select("user_id", names.slice_name(F.col("idx"), F.col("label")).alias("name"))


RUNNING_SQL = """
    SELECT l_orderkey, l_linenumber, l_partkey,
           (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1)::BIGINT AS idx
    FROM lineitem
    """


def order_lines(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    # A crowded order is cut by line number and by ranges of the part number.
    cuts = [F.col("l_linenumber"), chunk_of("l_partkey")]
    return number_copies(rows, "l_orderkey", ["l_linenumber", "l_partkey"], "idx", chunk=cuts, **options)


@query("running_number", RUNNING_SQL)
def running_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_lines(spark, sf_dir)


@query("running_number_cut", RUNNING_SQL)
def running_number_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same numbers with every order of over two lines cut."""
    return order_lines(spark, sf_dir, hot_rows=2)


LINES_SQL = """
    (SELECT l_orderkey, l_linenumber, l_partkey,
            (row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey) - 1)::BIGINT AS idx
     FROM lineitem)
"""


def lines_at(spark: SparkSession, sf_dir: str, first: int, n: int, **options: int) -> DataFrame:
    keys = ["l_orderkey", "l_linenumber", "l_partkey"]
    return sampling.slice_at(table(spark, sf_dir, "lineitem").select(*keys), keys, first, n, **options)


@query("slice_at", f"SELECT * FROM {LINES_SQL} WHERE idx BETWEEN 200 AND 209")
def slice_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_at(spark, sf_dir, 200, 10)


@query("slice_at_deep", f"SELECT * FROM {LINES_SQL} WHERE idx BETWEEN 30000 AND 30999")
def slice_at_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Far from the start; several rounds of counting leave a hundred rows besides."""
    return lines_at(spark, sf_dir, 30_000, 1_000, pivots=15, small=100)


@query("sample_cap", "SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 20")
def sample_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample_cap(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", 20)


@query("preview", "SELECT event_id, user_id, value FROM events ORDER BY event_id LIMIT 32 OFFSET 200")
def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return sampling.preview(rows, "event_id", 200)


@query(
    "slice_windows",
    """
    SELECT doc_id, count(*) AS n_slices, sum(s * 4)::BIGINT AS sum_beg, max(s * 4 + 15)::BIGINT AS last_end
    FROM (SELECT doc_id, unnest(range((n_chars + 16 - 16) // 4 + 1)) AS s FROM documents)
    GROUP BY doc_id
    """,
)
def slice_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    cut = slicing.slice_windows(rows, "n_chars", pad=G.SIDE_PAD)
    return cut.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_slices"), F.sum("beg").alias("sum_beg"), F.max("end").alias("last_end")
    )


@query(
    "slice_payload",
    """
    SELECT doc_id, count(*) AS n_slices, min(piece) AS min_piece, max(piece) AS max_piece,
           sum(length(trim(piece, ' ')))::BIGINT AS chars
    FROM (
        SELECT doc_id, substring(text, s * 4 + 1, 16) AS piece
        FROM (SELECT doc_id, text, unnest(range((length(text) - 16) // 4 + 1)) AS s
              FROM documents WHERE length(text) >= 16)
    ) GROUP BY doc_id
    """,
)
def slice_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices are summed up in the row of their text, so that none is sorted; texts of one document come together after that."""
    cut = slicing.slice_text(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", listed=True)
    per_text = cut.select(
        "doc_id",
        F.array_size("pieces").alias("n_slices"),
        F.array_min("pieces").alias("min_piece"),
        F.array_max("pieces").alias("max_piece"),
        F.aggregate("pieces", F.lit(0).cast("bigint"), lambda n, p: n + F.length(F.trim(p))).alias("chars"),
    )
    return per_text.groupBy("doc_id").agg(
        F.sum("n_slices").alias("n_slices"),
        F.min("min_piece").alias("min_piece"),
        F.max("max_piece").alias("max_piece"),
        F.sum("chars").alias("chars"),
    ).where("n_slices > 0")


@query(
    "slice_mid",
    """
    SELECT doc_id, count(*) AS n_slices, sum((s * 8 + 15) // 2)::BIGINT AS sum_mid,
           max((s * 8 + 15) // 2)::BIGINT AS last_mid
    FROM (SELECT doc_id, unnest(range((n_chars - 16) // 4 + 1)) AS s FROM documents WHERE n_chars >= 16)
    GROUP BY doc_id
    """,
)
def slice_mid(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = slicing.slice_windows(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars")
    mid = G.slice_mid(F.col("beg"), F.col("end"))
    return cut.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_slices"), F.sum(mid).alias("sum_mid"), F.max(mid).alias("last_mid")
    )


@query(
    "origin_x",
    """
    SELECT doc_id, min(x)::BIGINT AS first_x, max(x)::BIGINT AS last_x, sum(x)::BIGINT AS sum_x
    FROM (
        SELECT doc_id, greatest(0, least(n_chars - 1, floor((s * 8 - 1) / 2.0))) AS x
        FROM (SELECT doc_id, n_chars, unnest(range(n_chars // 4 + 1)) AS s FROM documents)
    ) GROUP BY doc_id
    """,
)
def origin_x(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    cut = slicing.slice_windows(rows, "n_chars", pad=G.SIDE_PAD)
    x = G.to_origin_x(F.col("beg"), F.col("end"), F.col("n_chars"))
    return cut.groupBy("doc_id").agg(
        F.min(x).alias("first_x"), F.max(x).alias("last_x"), F.sum(x).alias("sum_x")
    )


@query(
    "slice_count",
    """
    SELECT lang, sum(CASE WHEN n_chars >= 16 THEN (n_chars - 16) // 4 + 1 ELSE 0 END)::BIGINT AS n_slices
    FROM documents GROUP BY lang
    """,
)
def slice_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    return rows.groupBy("lang").agg(F.sum(G.slice_count(F.col("n_chars"))).alias("n_slices"))


# A document set in lines of 64 characters is as many rows high.
BLOCK_SQL = "(SELECT doc_id, (n_chars + 63) // 64 AS h, n_chars AS w FROM documents)"


def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    return rows.select("doc_id", G.int_div(F.col("n_chars") + 63, 64).alias("h"), F.col("n_chars").alias("w"))


@query("drop_tall", f"SELECT doc_id, h, w FROM {BLOCK_SQL} WHERE h < 48")
def drop_tall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slicing.drop_tall(text_blocks(spark, sf_dir), "h")


@query(
    "pad_plan",
    f"""
    SELECT doc_id, ((48 - h) // 2)::BIGINT AS pad_top, (48 - h - (48 - h) // 2)::BIGINT AS pad_bottom,
           (((4 - w % 4) % 4) // 2)::BIGINT AS pad_left,
           ((4 - w % 4) % 4 - ((4 - w % 4) % 4) // 2)::BIGINT AS pad_right
    FROM {BLOCK_SQL} WHERE h < 48
    """,
)
def pad_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = slicing.drop_tall(text_blocks(spark, sf_dir), "h")
    amounts = G.pad_amounts(F.col("h"), F.col("w"))
    return rows.select("doc_id", *[c.cast("bigint").alias(f"pad_{side}") for side, c in amounts.items()])


@query(
    "crop_plan",
    f"""
    SELECT doc_id, (greatest(h - 48, 0) // 2)::BIGINT AS crop_above,
           (greatest(h - 48, 0) - greatest(h - 48, 0) // 2)::BIGINT AS crop_below
    FROM {BLOCK_SQL}
    """,
)
def crop_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    amounts = G.crop_amounts(F.col("h"))
    return text_blocks(spark, sf_dir).select(
        "doc_id", *[c.cast("bigint").alias(f"crop_{side}") for side, c in amounts.items()]
    )


@query("fit_height", f"SELECT doc_id, CASE WHEN h > 80 THEN 128 ELSE 64 END AS height FROM {BLOCK_SQL}")
def fit_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_blocks(spark, sf_dir).select("doc_id", G.target_height(F.col("h")).alias("height"))


@query(
    "slice_image",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, o_custkey, o_totalprice
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    """,
)
def slice_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    slices = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    images = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_totalprice"
    )
    return slicing.join_images(slices, images, "l_orderkey")


WINDOWS_SQL = f"""
    (SELECT w::BIGINT AS window_id, (pos - w * 40)::BIGINT AS item_no, event_id, label
     FROM (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS pos, count(*) OVER () AS n FROM {EVENTS_SQL}),
          (SELECT unnest(range(count(*) // 40 + 1)) AS w FROM events)
     WHERE pos BETWEEN w * 40 AND w * 40 + 79 AND w * 40 + 80 < n)
"""


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.count_windows(labelled_events(spark, sf_dir), "event_id")


@query("count_windows", f"SELECT window_id, item_no, event_id FROM {WINDOWS_SQL}")
def count_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_windows(spark, sf_dir).select("window_id", "item_no", "event_id")


@query(
    "sequence_pack",
    f"""
    SELECT window_id, count(*)::BIGINT AS n_items, min(event_id)::BIGINT AS first_id,
           max(event_id)::BIGINT AS last_id, md5(string_agg(label::VARCHAR, '' ORDER BY item_no)) AS labels_md5
    FROM {WINDOWS_SQL} GROUP BY window_id
    """,
)
def sequence_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = sequences.sequence_pack(event_windows(spark, sf_dir), ["event_id", "label"])
    ids = F.transform("items", lambda s: s["event_id"])
    text = F.array_join(F.transform("items", lambda s: s["label"].cast("string")), "")
    return packed.select(
        "window_id",
        F.size("items").cast("bigint").alias("n_items"),
        F.array_min(ids).alias("first_id"),
        F.array_max(ids).alias("last_id"),
        F.md5(text).alias("labels_md5"),
    )


@query("flatten_sequences", f"SELECT window_id, item_no, event_id, label FROM {WINDOWS_SQL}")
def flatten_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = sequences.sequence_pack(event_windows(spark, sf_dir), ["event_id", "label"])
    return sequences.flatten_sequences(packed, ["window_id"])


CONTEXT_SQL = f"""
    SELECT user_id, event_id, label,
           coalesce(lag(label, 1) OVER w, 0) AS label_prev1, coalesce(lag(label, 2) OVER w, 0) AS label_prev2,
           coalesce(lead(label, 1) OVER w, 0) AS label_next1, coalesce(lead(label, 2) OVER w, 0) AS label_next2
    FROM {EVENTS_SQL} WINDOW w AS (PARTITION BY user_id ORDER BY event_id)
    """


@query("context_features", CONTEXT_SQL)
def context_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.context_features(labelled_events(spark, sf_dir), "user_id", "event_id", "label", 2)


@query("context_features_cut", CONTEXT_SQL)
def context_features_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same columns with every user of over 20 events cut into chunks."""
    rows = labelled_events(spark, sf_dir)
    return sequences.context_features(rows, "user_id", "event_id", "label", 2, bits=4, hot_rows=20)


SHEET_SQL = f"(SELECT *, idx // 41 AS row_no, idx % 41 AS col_no FROM {NUMBERED_SQL})"


@query(
    "sheet_layout",
    f"SELECT user_id, event_id, row_no::BIGINT AS row_no, col_no::BIGINT AS col_no FROM {SHEET_SQL}",
)
def sheet_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    laid_out = review.sheet_layout(labelled_events(spark, sf_dir), "user_id", "event_id")
    return laid_out.select("user_id", "event_id", "row_no", "col_no")


@query(
    "contact_sheet",
    f"""
    SELECT user_id, row_no::BIGINT AS row_no, md5(
        '<tr>' || string_agg('<td id="c' || t || '">' || t || '</td>', '' ORDER BY idx) || '</tr>'
        || '<tr>' || string_agg('<td>' || substring(i, 2) || '</td>', '' ORDER BY idx) || '</tr>'
        || '<tr>' || string_agg('<td><img src="word_seg_' || i || '_type_' || t
                                || '.png" width="32" height="96"></td>', '' ORDER BY idx) || '</tr>') AS html_md5
    FROM (SELECT *, printf('%04d', idx) AS i, printf('%02d', label) AS t FROM {SHEET_SQL})
    GROUP BY user_id, row_no
    """,
)
def contact_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = numbered_events(spark, sf_dir).select(
        "user_id",
        F.floor(F.col("idx") / review.SHEET_WIDTH).alias("row_no"),
        (F.col("idx") % review.SHEET_WIDTH).alias("col_no"),
        F.format_string("%04d", "idx").alias("i"),
        F.format_string("%02d", "label").alias("t"),
        names.slice_name(F.col("idx"), F.col("label")).alias("name"),
    )
    sheet = review.contact_sheet(named, "user_id", "i", "t", "name")
    return sheet.select("user_id", "row_no", F.md5("html").alias("html_md5"))


@query(
    "collect_columns",
    """
    SELECT conv_id, (turn // 4096)::BIGINT AS page_no, count(*)::BIGINT AS n_turns,
           string_agg(role, ',' ORDER BY turn) AS roles,
           md5(string_agg(text, '|' ORDER BY turn)) AS text_md5
    FROM conversations GROUP BY 1, 2
    """,
)
def collect_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    listed = sequences.collect_columns(rows, "conv_id", "turn", ["role", "text"])
    return listed.select(
        "conv_id",
        "page_no",
        F.size("role").cast("bigint").alias("n_turns"),
        F.array_join("role", ",").alias("roles"),
        F.md5(F.array_join("text", "|")).alias("text_md5"),
    )
