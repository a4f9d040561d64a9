"""Feeds, logs and exports as files: XML items, JSON in log lines, CSV."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: An item as it stands in a feed; elements may be missing.
ITEM = "title string, link string, guid struct<_VALUE:string,_isPermaLink:string>, creator string, pubDate string, description string, category array<string>"


def read_items(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """Items of RSS files, coerced: link, title, guid, author, categories, published text."""
    raw = spark.read.format("xml").schema(ITEM).option("rowTag", "item").load(path)
    items = raw.select(
        F.trim("link").alias("link"), to_text(F.col("title")).alias("title"), F.coalesce("guid._VALUE", "link").alias("guid"), to_text(F.col("creator")).alias("author"),
        F.slice(F.array_distinct(F.filter(F.transform("category", lambda c: F.trim(c)), lambda c: c != "")), 1, 25).alias("categories"), "pubDate", "description",
    )
    return items if most is None else items.limit(most)


def to_text(c: Column) -> Column:
    """Trimmed text; empty is null."""
    return F.nullif(F.trim(c), F.lit(""))


def to_bool(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin("true", "1", "yes"), F.lit(False))


def unseen(items: DataFrame, seen: DataFrame) -> DataFrame:
    """Feeds whose etag isn't the one that was stored: the others haven't changed."""
    return items.join(seen, ["feed_url", "etag"], "left_anti")


def json_records(lines: DataFrame, marker: str, schema: str, line: str = "value") -> DataFrame:
    """Records of the JSON object after ``marker`` in log lines; malformed ones and lines without one are left out.

    The JSON reader begins at the first brace and stops where the object ends, so what follows on the line, braces
    among it, does no harm, nor do braces inside of strings.
    """
    rest = F.substring_index(F.col(line), marker, -1)
    body = F.regexp_extract(rest, r"(?s)(\{.*)", 1)
    parsed = F.from_json(body, schema, {"mode": "PERMISSIVE"})
    return lines.filter(F.col(line).contains(marker)).select(parsed.alias("r")).filter("r is not null").select("r.*").dropna(how="all")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with a header, values as they stand: nothing is null, an empty value in quotes is empty text."""
    # Spark takes both for null unless quotes around nothing have a mark of their own, which no text may equal.
    empty = uuid.uuid4().hex
    df = spark.read.csv(path, schema=schema, header=True, quote='"', escape='"', charToEscapeQuoteEscaping='"', multiLine=True, emptyValue=empty, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    texts = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}
    return df.select(*(F.when(F.col(f"`{c}`") == empty, "").otherwise(F.col(f"`{c}`")).alias(c) if c in texts else F.col(f"`{c}`") for c in df.columns))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; values with commas, quotes or line ends are quoted and quotes doubled, blanks around them kept; null is nothing at all."""
    df.write.csv(path, header=True, quote='"', escape='"', charToEscapeQuoteEscaping='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def scraper_events(lines: DataFrame, line: str = "value") -> DataFrame:
    """Kind, source, characters and reason of scraper log lines."""
    low = F.lower(line)
    kind = F.when(low.contains("success"), "success").when(low.contains("failed"), "failure").when(low.contains("skipp"), "skip").otherwise("other")
    return lines.select(
        kind.alias("kind"), to_text(F.regexp_extract(line, r"source=(\S+)", 1)).alias("source"),
        F.nullif(F.regexp_extract(line, r"chars=(\d+)", 1), F.lit("")).cast("long").alias("chars"), to_text(F.regexp_extract(line, r"reason=(.+)$", 1)).alias("reason"),
    )
