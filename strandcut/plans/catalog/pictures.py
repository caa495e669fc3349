"""Pixel kernels over pictures that Spark makes from the documents.

A document's characters, 16 rows high, are the gray levels of a line image;
the last row is filled up with white. A document without characters (null or
empty text) has no picture, as in the SQL.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandcut.functions.geometry import SLICE_HEIGHT, SLICE_WIDTH
from strandcut.operators import pixels as P
from strandcut.operators import scoring
from strandcut.operators.slicing import drop_tall
from strandcut.plans.catalog.registry import query, table

HEIGHT = 16


def text_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    latin = F.regexp_replace("text", "[^\\x{0}-\\x{FF}]", "?")
    w = F.ceil(F.length("text") / HEIGHT).cast("int")
    # As after an image scan: spread the lines before the costly kernels.
    return table(spark, sf_dir, "documents").where(F.length("text") > 0).repartition("doc_id").select(
        "doc_id",
        F.lit(HEIGHT).alias("h"),
        w.alias("w"),
        F.encode(F.rpad(latin, w * HEIGHT, F.lit("ÿ")), "ISO-8859-1").alias("px"),
    )


PIXELS_SQL = """
    (SELECT doc_id, w, i % w AS x, i // w AS y,
            CASE WHEN i >= length(text) THEN 255 WHEN unicode(chars[i + 1]) > 255 THEN 63
                 ELSE unicode(chars[i + 1]) END AS v
     FROM (SELECT doc_id, text, string_split(text, '') AS chars, (length(text) + 15) // 16 AS w,
                  unnest(range(((length(text) + 15) // 16) * 16)) AS i
           FROM documents))
"""


def _mirror(at: str, n: str) -> str:
    period = f"greatest(2 * ({n} - 1), 1)"
    inside = f"((({at}) % {period} + {period}) % {period})"
    return f"CASE WHEN {n} = 1 THEN 0 WHEN {inside} >= {n} THEN {period} - {inside} ELSE {inside} END"


BLUR_SQL = f"""
    taps(d, k) AS (VALUES (-2, 1), (-1, 4), (0, 6), (1, 4), (2, 1)),
    px AS MATERIALIZED {PIXELS_SQL},
    across AS MATERIALIZED (
        SELECT t.doc_id, t.w, t.x, t.y, sum(t.k * s.v) AS v
        FROM (SELECT doc_id, w, x, y, k, {_mirror('x + d', 'w')} AS sx FROM px, taps) t
        JOIN px s ON s.doc_id = t.doc_id AND s.y = t.y AND s.x = t.sx GROUP BY 1, 2, 3, 4),
    blurred AS MATERIALIZED (
        SELECT t.doc_id, t.w, t.x, t.y, floor(sum(t.k * s.v) / 256.0 + 0.5)::BIGINT AS v
        FROM (SELECT doc_id, w, x, y, k, {_mirror('y + d', '16')} AS sy FROM px, taps) t
        JOIN across s ON s.doc_id = t.doc_id AND s.x = t.x AND s.y = t.sy GROUP BY 1, 2, 3, 4),
    hist AS (SELECT doc_id, v, count(*) AS n FROM blurred GROUP BY 1, 2),
    sums AS (SELECT doc_id, v, sum(n) OVER upto::DOUBLE AS w0, sum(n * v) OVER upto::DOUBLE AS s0,
                    sum(n) OVER every::DOUBLE AS wt, sum(n * v) OVER every::DOUBLE AS st
             FROM hist WINDOW upto AS (PARTITION BY doc_id ORDER BY v), every AS (PARTITION BY doc_id)),
    levels AS (SELECT doc_id, CASE WHEN max(var) > 0 THEN arg_max(v, (var, -v)) ELSE 0 END AS level
               FROM (SELECT doc_id, v, CASE WHEN w0 < wt THEN (s0 * wt - st * w0) ^ 2 / (w0 * (wt - w0)) ELSE 0 END AS var
                     FROM sums) GROUP BY doc_id),
    ink AS (SELECT b.doc_id, any_value(b.w) AS w, b.x, count(*) FILTER (WHERE b.v <= l.level) AS ink
            FROM blurred b JOIN levels l ON b.doc_id = l.doc_id GROUP BY b.doc_id, b.x),
    bounds AS (SELECT doc_id, w, greatest(coalesce(min(x) FILTER (WHERE ink > 5), w) - 16, 0) AS beg,
                      least(coalesce(max(x) FILTER (WHERE ink > 5), w - 1) + 16, w - 1) AS fin
               FROM ink GROUP BY doc_id, w)
"""


@query(
    "picture_ink",
    f"WITH {BLUR_SQL} SELECT doc_id, x::INTEGER AS x, ink::INTEGER AS ink FROM ink",
)
def picture_ink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Black pixels per column after smoothing and thresholding."""
    clean = P.map_images(text_pictures(spark, sf_dir), P.compose(P.blur, P.threshold))
    return P.column_ink(clean).select("doc_id", F.posexplode_outer("ink").alias("x", "ink"))


@query(
    "picture_crop",
    f"""
    WITH {BLUR_SQL}
    SELECT doc_id, beg::INTEGER AS crop_beg, fin::INTEGER AS crop_end, 48::INTEGER AS h,
           ((fin - beg + 4) // 4 * 4)::INTEGER AS w
    FROM bounds
    """,
)
def picture_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept columns and padded size of each line."""
    lines = drop_tall(text_pictures(spark, sf_dir), "h")
    return P.strip_and_pad(lines).select("doc_id", "crop_beg", "crop_end", "h", "w")


@query(
    "picture_slices",
    f"""
    WITH {BLUR_SQL},
    padded AS (SELECT doc_id, beg, fin, (fin - beg + 4) // 4 * 4 AS pw FROM bounds),
    cols AS (SELECT p.doc_id, p.x - b.beg + (b.pw - (b.fin - b.beg + 1)) // 2 AS x, sum(255 - p.v) AS dark
             FROM px p JOIN padded b ON b.doc_id = p.doc_id AND p.x BETWEEN b.beg AND b.fin GROUP BY 1, 2),
    cuts AS (SELECT doc_id, unnest(range((pw - 16) // 4 + 1)) AS s FROM padded WHERE pw >= 16)
    SELECT c.doc_id, c.s::INTEGER AS slice_no, (c.s * 4)::INTEGER AS beg,
           (48 * 16 * 255 - coalesce(sum(k.dark), 0))::DOUBLE AS brightness
    FROM cuts c LEFT JOIN cols k ON k.doc_id = c.doc_id AND k.x BETWEEN c.s * 4 AND c.s * 4 + 15
    GROUP BY 1, 2, 3
    """,
)
def picture_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every slice of every line, scored by a model that adds up its gray levels."""
    lines = drop_tall(text_pictures(spark, sf_dir), "h")
    total = scoring.linear_model(np.ones((1, SLICE_HEIGHT * SLICE_WIDTH)), np.zeros(1))
    scored = scoring.score_pixels(P.slice_pixels(P.strip_and_pad(lines)), total)
    return scored.select("doc_id", "slice_no", "beg", F.get("scores", F.lit(0)).alias("brightness"))
