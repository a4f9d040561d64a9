"""Ingestion as a stream: late rows dropped by a watermark, one row per key, idempotent batches, activity sessions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fresh_once(stream: DataFrame, keys: list[str], time: str = "published_at", late: str = "96 hours") -> DataFrame:
    """The first row of every key; rows later than ``late`` behind the newest are dropped and so is their state."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def counts_per_window(stream: DataFrame, by: str, time: str = "ts", width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    windowed = stream.withWatermark(time, late).groupBy(F.window(time, width), by).count()
    return windowed.select(F.col("window.start").alias("start"), by, F.col("count").alias("n"))


def sessions(stream: DataFrame, by: str, time: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of activity without a pause of ``gap``."""
    found = stream.withWatermark(time, late).groupBy(F.session_window(time, gap), by).agg(F.count("*").alias("n"))
    return found.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), by, "n")


def run_once(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Everything there is, in batches that ``sink`` gets with their numbers; a batch that is repeated has its number again."""
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def parquet_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Writes each batch to a folder of its own, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
