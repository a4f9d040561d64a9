"""The story model's frames, taken from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-31 00:00:00"

#: The same frames in SQL.
ARTICLES_SQL = f"""articles AS (
  SELECT doc_id AS id, substr(replace(text, chr(10), ' '), 1, 80) AS title, text AS content, source AS source_name, lang,
    source || '.example.com' AS source_domain, TIMESTAMP '{AS_OF}' - to_hours(CAST(doc_id % 720 AS INTEGER)) AS published_at
  FROM documents)"""
JOBS_SQL = f"""jobs AS (
  SELECT event_id AS id, event_type AS job_type, md5(props || CAST(user_id AS VARCHAR)) AS payload_hash, CAST(event_id % 5 AS INTEGER) AS attempts, 4 AS max_attempts,
    CASE WHEN event_id % 7 < 3 THEN 'pending' WHEN event_id % 7 < 5 THEN 'processing' ELSE 'done' END AS status,
    CASE WHEN event_id % 11 = 0 THEN NULL ELSE ts + INTERVAL 1 HOUR END AS run_at,
    CASE WHEN event_id % 7 BETWEEN 3 AND 4 THEN ts END AS started_at, CASE WHEN event_id % 7 >= 5 THEN ts + INTERVAL 2 HOUR END AS processed_at, ts AS created_at
  FROM events)"""
LINKS_SQL = "links AS (SELECT vec_id AS article_id, label AS story_id, vec_id % 7 = 0 AS is_primary, round((vec_id % 100) / 100.0, 2) AS similarity FROM embeddings WHERE label IS NOT NULL)"
STORIES_SQL = f"""stories AS (
  SELECT l.story_id AS id, min(a.published_at) AS first_seen_at, max(a.published_at) AS last_article_at, CAST(count(*) AS BIGINT) AS source_count
  FROM links l JOIN articles a ON a.id = l.article_id GROUP BY 1)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles: the first 80 characters are the title, hours by id the time of publication."""
    hours = f"timestamp_ntz'{AS_OF}' - make_interval(0, 0, 0, 0, cast(doc_id % 720 AS int), 0, 0)"
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.substring(F.replace("text", F.lit("\n"), F.lit(" ")), 1, 80).alias("title"), F.col("text").alias("content"),
        F.col("source").alias("source_name"), "lang", F.concat("source", F.lit(".example.com")).alias("source_domain"), F.expr(hours).alias("published_at"),
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as jobs of a queue."""
    r = F.col("event_id") % 7
    ts = F.col("ts").cast("timestamp_ntz")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("job_type"), F.md5(F.concat("props", F.col("user_id").cast("string"))).alias("payload_hash"), (F.col("event_id") % 5).cast("int").alias("attempts"),
        F.lit(4).alias("max_attempts"), F.when(r < 3, "pending").when(r < 5, "processing").otherwise("done").alias("status"),
        F.when(F.col("event_id") % 11 != 0, ts + F.expr("INTERVAL 1 HOUR")).alias("run_at"), F.when(r.between(3, 4), ts).alias("started_at"),
        F.when(r >= 5, ts + F.expr("INTERVAL 2 HOURS")).alias("processed_at"), ts.alias("created_at"),
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as links of articles to stories, which are the labels."""
    return table(spark, sf_dir, "embeddings").filter("label is not null").select(
        F.col("vec_id").alias("article_id"), F.col("label").alias("story_id"), (F.col("vec_id") % 7 == 0).alias("is_primary"), F.round((F.col("vec_id") % 100) / 100.0, 2).alias("similarity"),
    )


def stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = links(spark, sf_dir).join(articles(spark, sf_dir), F.col("article_id") == F.col("id"))
    return joined.groupBy(F.col("story_id").alias("id")).agg(
        F.min("published_at").alias("first_seen_at"), F.max("published_at").alias("last_article_at"), F.count("*").alias("source_count")
    )
