"""Gates of ingestion: relevance, freshness and search terms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline import config
from weftline.functions.text import ascii_edges
from weftline.operators.queue import timestamp


def any_pattern(c: Column, patterns: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, [c.rlike(ascii_edges(p)) for p in patterns], F.lit(False))


def relevance(text: Column, path: Column, required: tuple[str, ...] = (), forbidden: tuple[str, ...] = (), allow: tuple[str, ...] = (), block: tuple[str, ...] = ()) -> Column:
    """Points of lower-case text and URL path; -1 where a required part of the path is missing or a forbidden one is there.

    A good path adds 1, a bad one takes 1; federal terms add 2, the boost 2; local terms take 2, or 1 with the boost.
    """
    boost = any_pattern(text, config.BOOST)
    local = any_pattern(text, (*config.LOCAL, *block))
    score = (
        F.when(path.rlike(config.PATH_GOOD), 1).otherwise(0) - F.when(path.rlike(config.PATH_BAD), 1).otherwise(0)
        + F.when(any_pattern(text, (*config.FEDERAL, *allow)), 2).otherwise(0) + F.when(boost, 2).otherwise(0)
        - F.when(~local, 0).when(boost, 1).otherwise(2)
    )
    missing = ~reduce(Column.__or__, [path.contains(p) for p in required]) if required else F.lit(False)
    closed = reduce(Column.__or__, [path.contains(p) for p in forbidden], F.lit(False))
    return F.when(missing | closed, -1).otherwise(score)


def split_fresh(items: DataFrame, as_of: str, hours: int = 96) -> tuple[DataFrame, DataFrame]:
    """Items of the last hours and those to log as skipped; times in the future are set to five minutes from now."""
    now = timestamp(as_of)
    clamped = items.withColumn("published_at", F.least("published_at", now + F.expr("INTERVAL 5 MINUTES")))
    fresh = F.coalesce(F.col("published_at") >= now - F.expr(f"INTERVAL {hours} HOURS"), F.lit(True))
    return clamped.filter(fresh).withColumn("outcome", F.lit("kept")), clamped.filter(~fresh).withColumn("outcome", F.lit("freshness_filter"))


def search_term(c: Column) -> Column:
    """A cleaned search term; null if it is too short or long, or holds an address, a URL or a long number."""
    term = F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    bad = (F.length(term) < 2) | (F.length(term) > 80) | term.rlike(r"@|https?:|[0-9]{7,}|[<>{}]")
    return F.when(~bad, term)


def entity_issues(counts: DataFrame) -> DataFrame:
    """``counts`` (id, n) with flags: wrong_prefix, generic, program, singleton, low_value, and duplicate for a name under several prefixes."""
    i, one = F.col("id"), F.col("n") == 1
    marked = counts.withColumns({"_prefix": F.regexp_extract(i, "^([A-Z]{2,3})-.+$", 1), "_name": F.regexp_extract(i, "^[A-Z]{2,3}-(.+)$", 1)})
    several = marked.filter("_name <> ''").groupBy("_name").agg(F.countDistinct("_prefix").alias("_k")).filter("_k > 1").select("_name", F.lit(True).alias("_several"))
    flags = {
        "wrong_prefix": i.rlike(f"(?i){config.WRONG_PREFIX}"), "generic": i.rlike(f"(?i){config.GENERIC_ENTITY}"), "program": i.rlike(f"(?i){config.PROGRAM_ENTITY}"), "singleton": one,
        "low_value": one & any_pattern(i, config.LOW_VALUE), "duplicate": F.coalesce("_several", F.lit(False)),
    }
    return marked.join(several, "_name", "left").withColumns(flags).drop("_prefix", "_name", "_several")
