"""Work queues as frames: who may run, who is claimed, what finishing and failing leave behind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STALE = "INTERVAL 5 MINUTES"


def timestamp(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def blocker(as_of: str) -> Column:
    """Why a job doesn't run now, first reason first."""
    now = timestamp(as_of)
    return (
        F.when(F.col("processed_at").isNotNull(), "already_processed")
        .when((F.col("status") == "processing") & (F.col("started_at") >= now - F.expr(STALE)), "processing_fresh")
        .when(F.col("run_at") > now, "future_run_at")
        .when(F.col("attempts") >= F.col("max_attempts"), "max_attempts_reached")
        .otherwise("runnable")
    )


def runnable(as_of: str) -> Column:
    now = timestamp(as_of)
    waiting = (F.col("status") == "pending") | F.coalesce((F.col("status") == "processing") & (F.col("started_at") < now - F.expr(STALE)), F.lit(False))
    due = F.col("run_at").isNull() | (F.col("run_at") <= now)
    return F.col("processed_at").isNull() & waiting & due & (F.col("max_attempts").isNull() | (F.col("attempts") < F.col("max_attempts")))


def claim(jobs: DataFrame, as_of: str, per_type: int = 1) -> DataFrame:
    """The first runnable jobs of every type: no set time first, then by time and id. Only pending jobs count an attempt."""
    order = Window.partitionBy("job_type").orderBy(F.col("run_at").asc_nulls_first(), "id")
    first = jobs.filter(runnable(as_of)).withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= per_type)
    counted = F.col("attempts") + (F.col("status") == "pending").cast("int")
    return first.withColumns({"attempts": counted, "status": F.lit("processing"), "started_at": timestamp(as_of)}).drop("_n")


def finish(jobs: DataFrame, done: DataFrame, as_of: str) -> DataFrame:
    """Jobs after the results (id, ok) in ``done``: failures wait 2 ** min(attempts, 10) minutes, or stop at the limit."""
    now = timestamp(as_of)
    wait = F.expr("make_interval(0, 0, 0, 0, 0, cast(pow(2, least(attempts, 10)) AS int), 0)")
    joined = jobs.join(done, "id", "left")
    over = F.col("attempts") >= F.col("max_attempts")
    return joined.select(
        "id", "job_type", "attempts",
        F.when(F.col("ok"), "done").when(~F.col("ok") & over, "failed").when(~F.col("ok"), "pending").otherwise(F.col("status")).alias("status"),
        F.when(~F.col("ok") & ~over, now + wait).otherwise(F.col("run_at")).alias("run_at"),
        F.when(F.col("ok") | (~F.col("ok") & over), now).otherwise(F.col("processed_at")).alias("processed_at"),
    )


def enqueue(active: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming jobs without an unprocessed job of the same type and payload; the first of those that repeat."""
    open_jobs = active.filter("processed_at is null").select("job_type", "payload_hash").distinct()
    first = Window.partitionBy("job_type", "payload_hash").orderBy("id")
    fresh = incoming.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    return fresh.join(open_jobs, ["job_type", "payload_hash"], "left_anti")


def reset_stuck(jobs: DataFrame, as_of: str, minutes: int = 30) -> DataFrame:
    now = timestamp(as_of)
    stuck = (F.col("status") == "processing") & (F.col("started_at") < now - F.expr(f"INTERVAL {minutes} MINUTES"))
    stuck = F.coalesce(stuck, F.lit(False))
    return jobs.withColumns({"status": F.when(stuck, "pending").otherwise(F.col("status")), "started_at": F.when(~stuck, F.col("started_at")), "was_stuck": stuck})
