"""Sinks that depend on what is stored: snapshots in, snapshots out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], order: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``stored`` after ``incoming``, with is_new and is_updated.

    Of incoming rows with one key the last by ``order`` counts. New values replace stored ones unless they are null;
    columns in ``keep`` stay as they are stored.
    """
    last = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    once = incoming.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")
    values = [c for c in stored.columns if c not in keys]
    old = stored.select(*keys, *(F.col(c).alias(f"_old_{c}") for c in values), F.lit(True).alias("_stored"))
    new = once.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in values), F.lit(True).alias("_came"))
    joined = old.join(new, keys, "full_outer")
    merged = [(F.coalesce(f"_old_{c}", f"_new_{c}") if c in keep else F.coalesce(f"_new_{c}", f"_old_{c}")).alias(c) for c in values]
    return joined.select(*keys, *merged, F.col("_stored").isNull().alias("is_new"), (F.col("_stored").isNotNull() & F.col("_came").isNotNull()).alias("is_updated"))


def insert_new(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows whose key isn't stored."""
    return incoming.join(stored.select(*keys).distinct(), keys, "left_anti")


def changed(stored: DataFrame, incoming: DataFrame, key: str, content: str) -> DataFrame:
    """Incoming rows that are new or whose content has another hash, with the hash."""
    hashed = incoming.withColumn("content_hash", F.sha2(F.coalesce(F.col(content), F.lit("")), 256))
    old = stored.select(key, F.sha2(F.coalesce(F.col(content), F.lit("")), 256).alias("_old"))
    return hashed.join(old, key, "left").filter(~F.col("content_hash").eqNullSafe(F.col("_old"))).drop("_old")


def add_counts(stored: DataFrame, seen: DataFrame, key: str, at: str) -> DataFrame:
    """Counters (key, n, first_seen, last_seen) after more sightings (key, at)."""
    new = seen.groupBy(key).agg(F.count("*").alias("n"), F.min(at).alias("first_seen"), F.max(at).alias("last_seen"))
    both = stored.select(key, "n", "first_seen", "last_seen").unionByName(new)
    return both.groupBy(key).agg(F.sum("n").alias("n"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def guarded_update(stored: DataFrame, wanted: DataFrame, key: str, stamp: str) -> DataFrame:
    """Compare-and-set: status of every wanted change (key, expected stamp): updated, conflict or missing."""
    now = stored.select(key, F.col(stamp).alias("_now"))
    status = F.when(F.col("_now").isNull(), "missing").when(F.col("_now") == F.col(stamp), "updated").otherwise("conflict")
    return wanted.join(now, key, "left").withColumn("status", status).drop("_now")
