"""The driver tables seen as articles, sources and health rows; the same in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire import values
from tidewire.functions.times import day_key

NOW = "2024-01-31 00:00:00"
TODAY = "2024-01-31"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as articles; scores are integral, every 97th id has no known day."""
    e = read(spark, sf_dir, "events")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    tag = lambda letter, n: F.concat(F.lit(letter), (k % n).cast("string"))
    unknown = F.col("event_id") % 97 == 0
    score = F.least(F.floor("value").cast("long"), F.lit(100))
    return e.select(
        F.col("event_id").alias("id"),
        F.when(unknown, values.SENTINEL).otherwise(day_key(F.col("ts"))).alias("date_key"),
        F.when(F.col("event_type") == "error", "noise").when(F.col("event_type") == "purchase", "policy").otherwise(F.col("event_type")).alias("category"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source_name"),
        F.concat(F.lit("https://www.s"), F.col("user_id").cast("string"), F.lit(".example/n/"), (F.col("event_id") % 400).cast("string"), F.when(F.col("event_id") % 3 == 0, "?utm_source=x").otherwise("")).alias("source_url"),
        F.concat(F.lit("Story "), k.cast("string"), F.lit(" of "), F.col("user_id").cast("string")).alias("title"),
        F.concat(F.lit("e"), (k * 7 % 60).cast("string")).alias("event_norm"),
        score.alias("ai_score"),
        (score >= 80).cast("long").alias("is_featured"),
        F.when(F.col("event_id") % 13 == 0, " ").otherwise("point").alias("takeaway"),
        F.when(F.col("event_id") % 17 == 0, "a�b").otherwise("plain").alias("summary"),
        F.array(tag("c", 20), tag("d", 9)).alias("companies"),
        F.array(tag("k", 50), tag("l", 11)).alias("keywords"),
        F.array(tag("r", 6)).alias("regions"),
        (F.col("event_id") % 4).alias("merged_count"),
        F.col("ts").alias("collected_at"),
    )


ARTICLES = """articles AS (SELECT *, regexp_extract(props, '([0-9]+)', 1)::BIGINT AS k FROM events),
a AS (SELECT event_id AS id,
  CASE WHEN event_id % 97 = 0 THEN 'unknown' ELSE strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d') END AS date_key,
  CASE event_type WHEN 'error' THEN 'noise' WHEN 'purchase' THEN 'policy' ELSE event_type END AS category,
  'u' || user_id AS source_name,
  'https://www.s' || user_id || '.example/n/' || (event_id % 400) || CASE WHEN event_id % 3 = 0 THEN '?utm_source=x' ELSE '' END AS source_url,
  'Story ' || k || ' of ' || user_id AS title, 'e' || (k * 7 % 60) AS event_norm,
  least(floor(value)::BIGINT, 100) AS ai_score, CASE WHEN floor(value) >= 80 THEN 1 ELSE 0 END::BIGINT AS is_featured,
  CASE WHEN event_id % 13 = 0 THEN ' ' ELSE 'point' END AS takeaway,
  CASE WHEN event_id % 17 = 0 THEN 'a�b' ELSE 'plain' END AS summary,
  ['c' || (k % 20), 'd' || (k % 9)] AS companies, ['k' || (k % 50), 'l' || (k % 11)] AS keywords, ['r' || (k % 6)] AS regions,
  event_id % 4 AS merged_count, ts AS collected_at FROM articles)"""


def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per source and day of the calendar with what was fetched; days without events count 0."""
    a = articles(spark, sf_dir).where("date_key <> 'unknown'")
    days = a.select("date_key").distinct()
    sources = a.select("source_name").distinct()
    got = a.where("category in ('click', 'signup', 'policy')").groupBy("source_name", "date_key").agg(F.count("*").alias("fetched"))
    span = days.agg(F.collect_set("date_key").alias("days"))  # a calendar: one row a day
    grid = sources.join(F.broadcast(span)).select("source_name", F.explode("days").alias("date_key"))
    return grid.join(got, ["source_name", "date_key"], "left").select("source_name", "date_key", F.coalesce("fetched", F.lit(0)).alias("fetched"))


HEALTH = """d AS (SELECT DISTINCT date_key FROM a WHERE date_key <> 'unknown'), s AS (SELECT DISTINCT source_name FROM a WHERE date_key <> 'unknown'),
g AS (SELECT source_name, date_key, count(*) AS n FROM a WHERE date_key <> 'unknown' AND category IN ('click', 'signup', 'policy') GROUP BY 1, 2),
h AS (SELECT s.source_name, d.date_key, coalesce(g.n, 0) AS fetched FROM s, d LEFT JOIN g ON g.source_name = s.source_name AND g.date_key = d.date_key)"""
