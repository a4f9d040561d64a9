"""Figures for dashboards and reviews: queues, runs, tabs, spending, clustering quality and labelled thresholds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.queue import timestamp
from weftline.operators.scoring import hours_between

# Minutes since the last run below which a pipeline is well, and below which it is late.
RUN_OK, RUN_LATE = 150, 240


def minutes_since(at: Column, as_of: str) -> Column:
    return F.floor(hours_between(timestamp(as_of), at) * 60).cast("long")


def queue_stats(jobs: DataFrame, as_of: str, stuck_minutes: int = 30) -> DataFrame:
    """Per job type, and in a row without a type for all: counts by status, the next run and the oldest pending job's, its age, and whether it is stuck.

    Pending jobs without a time count, but say nothing of age. In all, anything stuck makes the total stuck.
    """
    waiting = F.when(F.col("status") == "pending", F.col("run_at"))
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("pending", "processing", "done", "failed")]
    stats = jobs.rollup("job_type").agg(*counts, F.min(waiting).alias("next_run_at"))
    age = F.greatest(F.coalesce(minutes_since(F.col("next_run_at"), as_of), F.lit(0)), F.lit(0))
    late = F.coalesce(hours_between(timestamp(as_of), F.col("next_run_at")) * 60 > stuck_minutes, F.lit(False))
    return stats.withColumns({"oldest_pending": F.col("next_run_at"), "age_minutes": age, "is_stuck": late})


def feed_counts(feeds: DataFrame, limit: int = 5) -> DataFrame:
    """One row: feeds in all, active ones below the failure limit, of these the ones that fail at times, and those at the limit."""
    well = F.col("is_active") & (F.col("failures") < limit)
    return feeds.agg(F.count("*").alias("feeds"), F.count_if(well).alias("active"), F.count_if(well & (F.col("failures") >= 1)).alias("degraded"), F.count_if(F.col("failures") >= limit).alias("failed"))


def review_counts(rows: DataFrame, name: str) -> DataFrame:
    """One row: rows in all, published, drafts and those to review, as ``name``_...; unknown flags count nowhere."""
    flags = {"published": F.col("is_public"), "draft": ~F.col("is_public"), "review": F.col("needs_review")}
    return rows.agg(F.count("*").alias(f"{name}_total"), *(F.count_if(flag).alias(f"{name}_{key}") for key, flag in flags.items()))


def pipeline_status(last_run: Column, as_of: str) -> Column:
    minutes = minutes_since(last_run, as_of)
    return F.when(last_run.isNull(), "unknown").when(minutes < RUN_OK, "ok").when(minutes < RUN_LATE, "warning").otherwise("error")


def side_by_side(parts: list[DataFrame]) -> DataFrame:
    """One row of frames that have one row each."""
    return reduce(lambda row, part: row.join(F.broadcast(part)), parts)


def facets(rows: DataFrame, names: list[str]) -> DataFrame:
    """(facet, value, n): counts of the values of every column in one pass; null is a value."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in names)))
    return rows.select(pairs.alias("p")).groupBy("p.facet", "p.value").agg(F.count("*").alias("n"))


def run_rollup(log: DataFrame, most: int = 50) -> DataFrame:
    """The newest runs of a log (run_id, status, duration, needs_review, created_at): start, duration, processed, flagged and counts by status."""
    runs = log.groupBy("run_id").agg(
        F.min("created_at").alias("started_at"), F.sum(F.coalesce("duration", F.lit(0.0))).alias("duration"), F.count_if(F.col("status") != "running").alias("processed"),
        F.count_if("needs_review").alias("flagged"), *(F.count_if(F.col("status") == s).alias(s) for s in ("running", "completed", "failed")),
    )
    return runs.orderBy(F.col("started_at").desc(), "run_id").limit(most)


def tabs(row: dict[str, Column]) -> dict[str, Column]:
    """Whether a record is in each tab; ``row`` has enriched, is_public, needs_review and latest, the status of its latest log entry."""
    enriched, public = row["enriched"], row["is_public"]
    return {
        "needs_review": enriched & ~public & row["needs_review"], "unenriched": ~enriched, "unpublished": enriched & ~public, "published": public,
        "failed": ~enriched & F.coalesce(row["latest"] == "failed", F.lit(False)), "all": F.lit(True),
    }


def nested_counts(rows: DataFrame, outer: str, inner: str) -> DataFrame:
    """(outer, total, parts): counts per outer value, with those of its inner values as an array of (value, n), most frequent first."""
    c = rows.groupBy(outer, inner).agg(F.count("*").alias("n"))
    parts = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), F.col(inner).alias("value"))))
    return c.groupBy(outer).agg(F.sum("n").alias("total"), F.transform(parts, lambda x: F.struct(x["value"].alias("value"), (-x["less"]).alias("n"))).alias("parts"))


def verdict_counts(log: DataFrame, limit: int) -> DataFrame:
    """(verdict, n, merged, truncated) of the newest ``limit`` rows of a log (verdict, merged, created_at, id); rows without a verdict are skipped.

    ``truncated`` says that the log has more rows than that.
    """
    newest = log.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(limit)
    more = log.agg((F.count("*") > limit).alias("truncated"))
    counts = newest.filter("verdict is not null").groupBy("verdict").agg(F.count("*").alias("n"), F.count_if("merged").alias("merged"))
    return counts.join(F.broadcast(more))


def clustering_quality(members: DataFrame, first: int = 20) -> DataFrame:
    """One row of rates and the score over stories given as (story, article, source, entities).

    Rates: stories with two articles or more; of these, those with two sources or more; and of the ``first`` of these by id, those
    whose articles all share an entity.
    """
    sizes = members.groupBy("story").agg(F.countDistinct("article").alias("n"), F.countDistinct("source").alias("sources"))
    asked = sizes.filter("n >= 2").orderBy("story").limit(first)
    each = members.join(F.broadcast(asked.select("story", "n")), "story").select("story", "n", "article", F.explode(F.array_distinct("entities")).alias("entity")).distinct()
    shared = each.groupBy("story", "n", "entity").agg(F.count("*").alias("k")).filter("k = n").select("story").distinct().agg(F.count("*").alias("common"))
    totals = sizes.agg(F.count("*").alias("stories"), F.count_if(F.expr("n >= 2")).alias("clustered"), F.count_if(F.expr("n >= 2 and sources >= 2")).alias("multi_source"))
    row = side_by_side([totals, asked.agg(F.count("*").alias("asked")), shared])

    def rate(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))

    score = 100 * (0.4 * rate("clustered", "stories") + 0.3 * rate("multi_source", "clustered") + 0.3 * rate("common", "asked"))
    return row.withColumn("score", score)


def threshold_table(labelled: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """(threshold, n, correct, false_strict, false_wide, upper_bound) of pairs (sim, label) that each threshold would attach.

    Labels are S same, D different and A ambiguous. Without a strict error among n, three in n bounds its rate from above, in per cent.
    """
    levels = F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")
    attached = labelled.select("sim", F.upper("label").alias("label"), levels).filter(F.col("sim") >= F.col("threshold"))
    counts = attached.groupBy("threshold").agg(
        F.count("*").alias("n"), F.count_if(F.col("label") == "S").alias("correct"), F.count_if(F.col("label") == "D").alias("false_strict"), F.count_if(F.col("label").isin("A", "D")).alias("false_wide"),
    )
    return counts.withColumn("upper_bound", F.when(F.col("false_strict") == 0, F.round(300 / F.col("n"), 1)))


def risk_score(sim: Column, hours: Column, corroboration: Column, margin: Column, candidates: Column) -> Column:
    """How risky a decision is, to two places: low similarity, long time, weak reasons, a small lead and many candidates add points."""
    points = [
        F.greatest(F.lit(0.0), (0.92 - sim) * 10), hours / 48 * 3, F.when(corroboration == "title_only", 5.0).when(corroboration == "entity", 1.0).otherwise(0.0),
        F.when((candidates >= 2) & (margin < 0.03), 3.0).otherwise(0.0), F.when(candidates > 10, 2.0).otherwise(0.0),
    ]
    return F.round(reduce(Column.__add__, points), 2)


def priority_sample(rows: DataFrame, strata: list[tuple[str, Column, int]], order: list, budget: int, baseline: int, seed: int, row_id: str) -> DataFrame:
    """Rows for review with ``stratum``: each stratum's first by ``order`` up to its share, all within ``budget``, then ``baseline`` others in a seeded shuffle.

    A row is in the first stratum that it fits. The shuffle orders rows by a hash of seed and id, so reruns agree.
    """
    place = F.coalesce(*(F.when(fits, k) for k, (_, fits, _) in enumerate(strata)))
    named = F.element_at(F.array(*(F.lit(name) for name, _, _ in strata)), F.col("_place") + 1)
    share = F.element_at(F.array(*(F.lit(n) for _, _, n in strata)), F.col("_place") + 1)
    marked = rows.withColumn("_place", place)
    # No stratum gives more than its share, so what is ordered as a whole is bounded.
    first = Window.partitionBy("_place").orderBy(*order, row_id)
    chosen = marked.filter("_place is not null").withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= share)
    chosen = chosen.orderBy("_place", "_n").limit(budget).withColumn("stratum", named)
    others = marked.join(F.broadcast(chosen.select(row_id)), row_id, "left_anti")
    shuffled = others.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(row_id).cast("string"))), row_id).limit(baseline)
    return chosen.drop("_place", "_n").unionByName(shuffled.withColumn("stratum", F.lit("baseline")).drop("_place"))


def spend_trend(days: DataFrame, as_of: str, recent: int = 3, baseline: int = 14) -> DataFrame:
    """One row from (day, spent): means of the last ``recent`` days and of the ``baseline`` days before them, the change projected to 30 days, and a band."""
    today = timestamp(as_of).cast("date")
    ago = F.datediff(today, F.col("day"))
    row = days.agg(
        F.coalesce(F.avg(F.when(ago.between(0, recent - 1), F.col("spent"))), F.lit(0.0)).alias("recent_avg"), F.coalesce(F.avg(F.when(ago.between(recent, recent + baseline - 1), F.col("spent"))), F.lit(0.0)).alias("baseline_avg"),
    )
    change = F.try_divide(F.col("recent_avg") - F.col("baseline_avg"), F.col("baseline_avg"))
    band = F.when(change.isNull(), "no baseline").when(change > 0.5, "alert").when(change > 0.2, "watch").otherwise("ok")
    return row.withColumns({"projected_delta": (F.col("recent_avg") - F.col("baseline_avg")) * 30, "band": band})


def missing_fields(rows: DataFrame, row_id: str, fields: list[str]) -> DataFrame:
    """(id, missing, complete): names of the fields that a row lacks, null or blank, and the share it has, in per cent."""
    lacks = F.array_compact(F.array(*(F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", F.lit(c)) for c in fields)))
    return rows.select(row_id, F.array_join(lacks, ",").alias("missing"), F.round(100 * (1 - F.size(lacks) / len(fields)), 1).alias("complete"))


def close_and_archive(stories: DataFrame, as_of: str, close_hours: int = 72, archive_days: int = 7) -> DataFrame:
    """Stories after upkeep: active ones first seen over ``close_hours`` ago are closed, closed ones over ``archive_days`` ago archived."""
    age = hours_between(timestamp(as_of), F.col("first_seen_at"))
    closed = F.when((F.col("status") == "active") & (age > close_hours), "closed").otherwise(F.col("status"))
    return stories.withColumn("status", F.when((closed == "closed") & (age > 24 * archive_days), "archived").otherwise(closed))


def removable_jobs(jobs: DataFrame, as_of: str, days: int = 30, most: int = 10_000) -> DataFrame:
    """Ids of the oldest finished jobs older than ``days``, at most ``most`` in one run."""
    old = F.col("processed_at").isNotNull() & (F.col("created_at") < timestamp(as_of) - F.make_dt_interval(days=F.lit(days)))
    return jobs.filter(old).orderBy("created_at", "id").limit(most).select("id")


def slug_fragmentation(members: DataFrame) -> DataFrame:
    """(slug, stories, articles) of slugs that more than one story has, given (story, slug) per article."""
    counts = members.filter("slug is not null").groupBy("slug").agg(F.countDistinct("story").alias("stories"), F.count("*").alias("articles"))
    return counts.filter("stories > 1")


def top_counters(members: DataFrame, most: int = 8) -> DataFrame:
    """(story, top): the ``most`` commonest entities of (story, article, entities) as an array of (entity, n); an article has one vote for each."""
    votes = members.select("story", "article", F.explode("entities").alias("entity")).filter("entity is not null").distinct()
    counts = votes.groupBy("story", "entity").agg(F.count("*").alias("n"))
    first = Window.partitionBy("story").orderBy(F.col("n").desc(), "entity")
    kept = counts.withColumn("_k", F.row_number().over(first)).filter(F.col("_k") <= most)
    ordered = F.array_sort(F.collect_list(F.struct("_k", "entity", "n")))
    return kept.groupBy("story").agg(F.transform(ordered, lambda x: F.struct(x["entity"].alias("entity"), x["n"].alias("n"))).alias("top"))
