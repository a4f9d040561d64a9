"""Upkeep of stories: survivors of merges, entity names, exact recomputation, merging, lifecycle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.vectors import mean_vectors
from weftline.plans.lineage import cut


def survivors(pointers: DataFrame) -> DataFrame:
    """(id, survivor) of rows (id, into_id): the end of each chain; null for cycles and pointers to nowhere.

    Every round doubles how far a row looks, so long chains take few joins.
    """
    known = pointers.select(F.col("id").alias("k"), F.col("into_id").alias("next"))
    now = cut(pointers.select("id", F.coalesce("into_id", "id").alias("at"), F.col("into_id").isNull().alias("done")))
    rounds = 0
    while rounds < 64:
        waiting = now.filter(~F.col("done")).count()
        if not waiting:
            break
        step = now.select(F.col("id").alias("k"), F.col("at").alias("to"), F.col("done").alias("ends"))
        joined = now.join(step, now["at"] == step["k"], "left")
        following = joined.select(
            "id", F.when(F.col("done"), F.col("at")).otherwise(F.col("to")).alias("at"),
            (F.col("done") | F.col("k").isNull() | F.coalesce("ends", F.lit(False))).alias("done"),
        )
        now, rounds = cut(following), rounds + 1
        if now.filter(~F.col("done")).count() == waiting:
            break
    ends = known.filter("next is null").select(F.col("k"))
    found = now.filter("done").join(ends, now["at"] == ends["k"], "left_semi").select("id", F.col("at").alias("survivor"))
    return pointers.select("id").join(found, "id", "left")


def normalise_entities(rows: DataFrame, key: str, raw: str, aliases: DataFrame, valid: str) -> DataFrame:
    """Distinct normalised entities per row, in order, by three lookups: as it is, upper case, any case.

    An alias without an entity blocks the name; what doesn't look like ``valid`` is left out. ``aliases`` is a
    parameter table of a few hundred names.
    """
    names = rows.select(key, F.explode(raw).alias("name")).withColumn("name", F.trim("name"))
    exact = F.broadcast(aliases.select(F.col("alias").alias("name"), F.col("entity").alias("e1"), F.lit(1).alias("h1")))
    lower = aliases.select(F.lower("alias").alias("low"), "entity").groupBy("low").agg(F.min("entity").alias("e2")).withColumn("h2", F.lit(1))
    found = names.join(exact, "name", "left").withColumn("low", F.lower("name")).join(F.broadcast(lower), "low", "left")
    entity = F.when(F.col("h1").isNotNull(), F.col("e1")).when(F.col("h2").isNotNull(), F.col("e2"))
    kept = found.select(key, entity.alias("entity")).filter(F.col("entity").rlike(valid)).distinct()
    return kept.groupBy(key).agg(F.array_sort(F.collect_list("entity")).alias("entities"))


def recompute(links: DataFrame, articles: DataFrame, top: int = 5) -> DataFrame:
    """Per story: exact mean vector, entity counts and the ``top`` entities (count descending, id ascending).

    ``articles`` has article_id, embedding and entities; an article counts an entity once.
    """
    joined = links.select("story_id", "article_id").join(articles, "article_id")
    centroids = mean_vectors(joined.filter("embedding is not null"), "story_id", "embedding")
    counts = joined.select("story_id", F.explode(F.array_distinct("entities")).alias("entity")).groupBy("story_id", "entity").count()
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("less"), F.col("entity").alias("entity"))))
    entities = counts.groupBy("story_id").agg(ordered.alias("all"), F.map_from_entries(F.collect_list(F.struct("entity", "count"))).alias("entity_counter"))
    entities = entities.select("story_id", "entity_counter", F.transform(F.slice("all", 1, top), lambda x: x["entity"]).alias("top_entities"))
    return centroids.join(entities, "story_id", "full_outer")


def recompute_stories(stories: DataFrame, links: DataFrame, articles: DataFrame, top: int = 5) -> DataFrame:
    """``stories`` (id, centroid, entity_counter, top_entities, slugs and others) as their articles have them now, with the cosine of old and new centroids as ``drift``.

    A story whose articles have any vector gets their exact mean, the counts of their entities, as often as articles list
    them, and the ``top`` of these by count and name; without entities both are empty. Other stories stay as they are. Slugs are those of all its
    articles, sorted. Only the first entities of a story are ordered; its counts are one map, as many as it has entities.
    """
    from pyspark.sql import Window

    from weftline.functions.vectors import cosine

    joined = links.select("story_id", "article_id").distinct().join(articles, "article_id")
    means = mean_vectors(joined.filter("embedding is not null"), "story_id", "embedding", "_mean")
    counts = joined.select("story_id", F.explode("entities").alias("e")).filter("e <> ''").groupBy("story_id", "e").agg(F.count("*").alias("n"))
    counts = cut(counts)
    order = Window.partitionBy("story_id").orderBy(F.desc("n"), "e")
    first = counts.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= top).groupBy("story_id").agg(F.array_sort(F.collect_list(F.struct("k", "e"))).alias("_top"))
    maps = counts.groupBy("story_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("e", "n")))).alias("_counter"))
    slugs = joined.groupBy("story_id").agg(F.array_sort(F.collect_set("slug")).alias("_slugs"))
    found = means.join(maps, "story_id", "left").join(first, "story_id", "left").join(slugs, "story_id", "left")
    after = stories.join(found.withColumnRenamed("story_id", "_id"), F.col("id") == F.col("_id"), "left")
    known = F.col("_id").isNotNull()
    none = F.array().cast("array<string>")
    return after.withColumns(
        {
            "drift": F.when(known & F.col("centroid").isNotNull(), F.round(cosine(F.col("centroid"), F.col("_mean")), 6)),
            "entity_counter": F.when(known, F.coalesce("_counter", F.map_from_arrays(none, F.array().cast("array<bigint>")))).otherwise(F.col("entity_counter")),
            "top_entities": F.when(known, F.coalesce(F.transform("_top", lambda x: x["e"]), none)).otherwise(F.col("top_entities")),
            "slugs": F.when(known, F.coalesce("_slugs", none)).otherwise(F.col("slugs")),
            "centroid": F.coalesce("_mean", "centroid"),
        }
    ).drop("_id", "_mean", "_counter", "_top", "_slugs")


def merge_stories(stories: DataFrame, links: DataFrame, wanted: DataFrame, cap: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stories, links and a result row per wanted merge (run_id, loser, survivor) after the merges.

    A merge is refused, for the first reason that holds, if both are one story, one of them is missing or merged
    already, either is part of an earlier merge of the run, or the run has had ``cap`` merges. Links of the loser move
    to the survivor, unless the article is linked there; times widen, counts are made anew and the loser points to the
    survivor.
    """
    from pyspark.sql import Window

    s = stories.select("id", F.col("merged_into").isNotNull().alias("gone"))
    asked = wanted.withColumn("n", F.row_number().over(Window.partitionBy("run_id").orderBy("loser", "survivor")))
    sides = asked.select("run_id", "n", F.explode(F.array("loser", "survivor")).alias("story")).groupBy("run_id", "story").agg(F.min("n").alias("first"))
    checked = (
        asked.join(s.withColumnsRenamed({"id": "loser", "gone": "loser_gone"}), "loser", "left")
        .join(s.withColumnsRenamed({"id": "survivor", "gone": "survivor_gone"}), "survivor", "left")
        .join(sides.withColumnsRenamed({"story": "loser", "first": "f1"}), ["run_id", "loser"])
        .join(sides.withColumnsRenamed({"story": "survivor", "first": "f2"}), ["run_id", "survivor"])
    )
    reason = (
        F.when(F.col("loser") == F.col("survivor"), "same_story").when(F.col("loser_gone").isNull() | F.col("survivor_gone").isNull(), "not_found")
        .when(F.col("loser_gone") | F.col("survivor_gone"), "already_merged").when((F.col("f1") < F.col("n")) | (F.col("f2") < F.col("n")), "in_earlier_merge")
    )
    checked = checked.withColumn("reason", reason)
    place = F.sum(F.col("reason").isNull().cast("int")).over(Window.partitionBy("run_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    result = cut(checked.withColumn("reason", F.when(F.col("reason").isNull() & (place > cap), "cap_reached").otherwise(F.col("reason"))).select("run_id", "loser", "survivor", "reason"))
    done = result.filter("reason is null").select("loser", "survivor")
    moved = links.join(done, links["story_id"] == done["loser"], "left").withColumn("story_id", F.coalesce("survivor", "story_id")).drop("loser", "survivor")
    moved = moved.dropDuplicates(["article_id", "story_id"])
    counts = moved.groupBy("story_id").agg(F.count("*").alias("n"))
    times = stories.join(done, stories["id"] == done["loser"]).groupBy("survivor").agg(F.min("first_seen_at").alias("f"), F.max("last_article_at").alias("l"))
    after = (
        stories.join(done.withColumnsRenamed({"loser": "lid", "survivor": "to"}), F.col("id") == F.col("lid"), "left")
        .join(times, F.col("id") == F.col("survivor"), "left").join(counts, F.col("id") == F.col("story_id"), "left")
        .select(
            "id", F.least("first_seen_at", "f").alias("first_seen_at"), F.greatest("last_article_at", "l").alias("last_article_at"),
            F.coalesce("n", F.lit(0)).alias("source_count"), F.coalesce("merged_into", "to").alias("merged_into"),
        )
    )
    return after, moved, result


def merge_lanes(pairs: DataFrame, days: int = 7, sim_two: float = 0.85, sim_three: float = 0.75) -> DataFrame:
    """``pairs`` (a_/b_ entities and seen times, sim) with shared_count, decision, lane, passed and blocked_by: whether two stories may merge, and why not.

    Three shared entities ask for less similarity than two; one or none is never enough. The first reason that blocks is given; what
    was passed before it is listed.
    """
    has = (F.size("a_entities") > 0) & (F.size("b_entities") > 0)
    n = F.greatest(F.size(F.array_intersect("a_entities", "b_entities")), F.lit(0))
    gap = F.abs(F.unix_micros(F.col("a_seen").cast("timestamp")) - F.unix_micros(F.col("b_seen").cast("timestamp"))) / 8.64e10
    sim = F.col("sim")
    blocked = (
        F.when(sim.isNull() | F.isnan(sim), "SIM_INVALID").when(~F.coalesce(has, F.lit(False)), "NO_ENTITIES").when(F.col("a_seen").isNull() | F.col("b_seen").isNull(), "NO_TIME").when(gap > days, "TIME_WINDOW")
        .when((n >= 3) & (sim < sim_three), "LOW_SIM_3").when((n == 2) & (sim < sim_two), "LOW_SIM_2").when(n == 1, "1_ENTITY_LANE_DISABLED").when(n == 0, "NO_ENTITY_OVERLAP")
    )
    entities, early = F.coalesce(has, F.lit(False)) & sim.isNotNull(), F.array(*map(F.lit, ("SIM_INVALID", "NO_ENTITIES", "NO_TIME", "TIME_WINDOW")))
    timed = ~F.coalesce(F.array_contains(early, blocked), F.lit(False))
    passed = F.array_compact(
        F.array(
            F.when(entities, "HAS_ENTITIES"), F.when(timed, "TIME_WINDOW_OK"), F.when(timed & (n >= 3), "ENTITY_OVERLAP_3+").when(timed & (n == 2), "ENTITY_OVERLAP_2").when(timed & (n == 1), "ENTITY_OVERLAP_1"),
            F.when(blocked.isNull(), F.when(n >= 3, "SIM_3_OK").otherwise("SIM_2_OK")),
        )
    )
    return pairs.withColumns({"shared_count": n, "decision": blocked.isNull(), "lane": F.when(blocked.isNull(), "multi_entity"), "passed": F.array_join(passed, ","), "blocked_by": blocked})
