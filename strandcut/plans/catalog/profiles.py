"""Ink profiles, smoothing, end stripping and thresholds over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandcut.operators import profiles
from strandcut.plans.catalog.registry import is_separator, query, table

# A user's events by hour form a profile: the hour is the image column, the
# events of a character type are its ink.
POINTS_SQL = """
    (SELECT user_id, date_diff('hour', TIMESTAMP '2024-01-01', ts) AS x,
            CASE WHEN event_type IN ('view', 'click', 'signup') THEN 1 ELSE 0 END AS ink FROM events)
"""
PROFILE_SQL = f"""
    (SELECT g.user_id, g.x::BIGINT AS x, coalesce(p.ink, 0)::BIGINT AS ink, g.width::BIGINT AS width
     FROM (SELECT user_id, max(x) + 1 AS width, unnest(range(max(x) + 1)) AS x FROM {POINTS_SQL} GROUP BY user_id) g
     LEFT JOIN (SELECT user_id, x, sum(ink) AS ink FROM {POINTS_SQL} GROUP BY 1, 2) p
       ON g.user_id = p.user_id AND g.x = p.x)
"""


def event_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.expr("timestampdiff(HOUR, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts)")
    points = table(spark, sf_dir, "events").select("user_id", hour.alias("hour"), (1 - is_separator()).alias("mark"))
    widths = points.groupBy("user_id").agg((F.max("hour") + 1).alias("w"))
    return profiles.ink_profile(points, "user_id", "hour", F.col("mark"), widths, "w")


@query("ink_profile", f"SELECT user_id, x, ink FROM {PROFILE_SQL}")
def ink_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_profile(spark, sf_dir).select("user_id", "x", "ink")


@query(
    "smooth_profile",
    f"""
    SELECT t.user_id, t.x::BIGINT AS x, round(sum(t.weight * p.ink) / 16.0, 5)::DOUBLE AS smooth
    FROM (SELECT user_id, x, weight, CASE
                 WHEN width = 1 THEN 0
                 WHEN m >= width THEN 2 * (width - 1) - m ELSE m END AS src
          FROM (SELECT user_id, x, width, weight,
                       CASE WHEN width = 1 THEN 0
                            ELSE (((x + k) % (2 * (width - 1))) + 2 * (width - 1)) % (2 * (width - 1)) END AS m
                FROM {PROFILE_SQL},
                     (VALUES (-2, 1), (-1, 4), (0, 6), (1, 4), (2, 1)) AS taps(k, weight))) t
    JOIN {PROFILE_SQL} p ON p.user_id = t.user_id AND p.x = t.src
    GROUP BY 1, 2
    """,
)
def smooth_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    smoothed = profiles.smooth_profile(event_profile(spark, sf_dir), "user_id")
    return smoothed.withColumn("smooth", F.round("smooth", 5))


@query(
    "strip_ends",
    f"""
    SELECT user_id, greatest(coalesce(b, width) - 16, 0)::BIGINT AS beg,
           least(coalesce(e, width - 1) + 16, width - 1)::BIGINT AS "end"
    FROM (SELECT user_id, max(width) AS width, min(x) FILTER (WHERE ink > 1) AS b, max(x) FILTER (WHERE ink > 1) AS e
          FROM {PROFILE_SQL} GROUP BY user_id)
    """,
)
def strip_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts are small, so more than one event already is ink."""
    return profiles.strip_ends(event_profile(spark, sf_dir), "user_id", min_ink=1)


GRAY_SQL = "(SELECT event_type, least(greatest(floor(value), 0), 255)::BIGINT AS v FROM events)"
OTSU_SQL = f"""
    (SELECT event_type, CASE WHEN max(var) > 0 THEN arg_max(v, (var, -v)) ELSE 0 END AS threshold
     FROM (SELECT event_type, v, CASE WHEN w0 < w
                  THEN (s0 * w - s * w0) * (s0 * w - s * w0) / (w0 * (w - w0)) ELSE 0 END AS var
           FROM (SELECT event_type, v,
                        sum(n) OVER upto::DOUBLE AS w0, sum(n * v) OVER upto::DOUBLE AS s0,
                        sum(n) OVER every::DOUBLE AS w, sum(n * v) OVER every::DOUBLE AS s
                 FROM (SELECT event_type, v, count(*) AS n FROM {GRAY_SQL} GROUP BY 1, 2)
                 WINDOW upto AS (PARTITION BY event_type ORDER BY v), every AS (PARTITION BY event_type)))
     GROUP BY event_type)
"""


@query(
    "otsu",
    f"""
    SELECT event_type, threshold::INTEGER AS threshold, count(*) FILTER (WHERE v > threshold) AS n_white,
           count(*) FILTER (WHERE v <= threshold) AS n_black
    FROM {GRAY_SQL} JOIN {OTSU_SQL} USING (event_type) GROUP BY 1, 2
    """,
)
def otsu(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.least(F.greatest(F.floor("value"), F.lit(0)), F.lit(255))
    gray = table(spark, sf_dir, "events").select("event_type", level.alias("v"))
    return profiles.class_sizes(gray, "event_type", "v")
