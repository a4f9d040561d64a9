"""Roll-ups, distributions, quality figures and samples as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.plans.registry import query
from weftline.sources import frames
from weftline.sources.frames import ARTICLES_SQL, AS_OF, JOBS_SQL, LINKS_SQL, STORIES_SQL, table


@query("a01_a10_event_rollup", """SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT user_id) AS BIGINT) AS users, round(avg(value), 4) AS mean, round(min(value), 4) AS low, round(max(value), 4) AS high,
  CAST(count(*) FILTER (WHERE value > 50) AS BIGINT) AS large, CAST(sum(CASE WHEN user_id < 50 THEN 1 ELSE 0 END) AS BIGINT) AS early_users, round(count(*) FILTER (WHERE value > 50) / nullif(count(*), 0), 6) AS share FROM events GROUP BY 1 HAVING count(*) > 3""")
def event_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = F.count_if(F.col("value") > 50)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.avg("value"), 4).alias("mean"), F.round(F.min("value"), 4).alias("low"), F.round(F.max("value"), 4).alias("high"),
        large.alias("large"), F.sum(F.when(F.col("user_id") < 50, 1).otherwise(0)).alias("early_users"), F.round(F.try_divide(large, F.count("*")), 6).alias("share"),
    ).filter("n > 3")


@query("a07_a44_string_agg", "SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, ', ' ORDER BY c_mktsegment) AS segments FROM customer GROUP BY 1")
def string_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ", ").alias("segments"))


@query("a08_spend_windows", f"SELECT round(COALESCE(sum(value) FILTER (WHERE CAST(ts AS DATE) = DATE '2024-01-30'), 0), 4) AS today, round(COALESCE(sum(value) FILTER (WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY AND ts < TIMESTAMP '{AS_OF}'), 0), 4) AS month FROM events")
def spend_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit(AS_OF).cast("timestamp")
    recent = (F.col("ts") >= now - F.expr("INTERVAL 30 DAYS")) & (F.col("ts") < now)
    total = lambda cond: F.round(F.coalesce(F.sum(F.when(cond, F.col("value"))), F.lit(0.0)), 4)
    return table(spark, sf_dir, "events").agg(total(F.to_date("ts") == F.lit("2024-01-30").cast("date")).alias("today"), total(recent).alias("month"))


@query("a09_hourly", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2")
def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH").alias("hour")
    return table(spark, sf_dir, "events").groupBy(hour, "event_type").agg(F.count("*").alias("n"))


@query("a12_a15_entity_counters", f"""WITH {ARTICLES_SQL}, {LINKS_SQL}, t AS (SELECT DISTINCT l.story_id, a.id, unnest(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(a.title), '[^a-z0-9]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: length(w) >= 4)) AS entity FROM links l JOIN articles a ON a.id = l.article_id),
  c AS (SELECT story_id, entity, count(*) AS n FROM t GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY n DESC, entity) AS k FROM c)
SELECT story_id, string_agg(entity || ':' || n, ',' ORDER BY n DESC, entity) FILTER (WHERE k <= 5) AS top_entities, CAST(count(*) AS BIGINT) AS entities FROM r GROUP BY 1""")
def entity_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = frames.links(spark, sf_dir).join(frames.articles(spark, sf_dir), F.col("article_id") == F.col("id"))
    words = joined.select("story_id", F.explode(F.array_distinct(T.tokens(F.col("title"), 4))).alias("entity")).groupBy("story_id", "entity").agg(F.count("*").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "entity")))
    top = F.transform(F.slice(ordered, 1, 5), lambda x: F.concat(x["entity"], F.lit(":"), (-x["less"]).cast("string")))
    return words.groupBy("story_id").agg(F.array_join(top, ",").alias("top_entities"), F.count("*").alias("entities"))


@query("a16_a17_rollups", "WITH c AS (SELECT event_type, CAST(date_part('dow', ts) AS INTEGER) AS day, count(*) AS n FROM events GROUP BY 1, 2) SELECT event_type, CAST(sum(n) AS BIGINT) AS total, string_agg(day || '=' || n, ' ' ORDER BY n DESC, day) AS days FROM c GROUP BY 1")
def rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "events").groupBy("event_type", (F.dayofweek("ts") - 1).alias("day")).agg(F.count("*").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "day")))
    days = F.transform(ordered, lambda x: F.concat_ws("=", x["day"].cast("string"), (-x["less"]).cast("string")))
    return c.groupBy("event_type").agg(F.sum("n").alias("total"), F.array_join(days, " ").alias("days"))


@query("a18_queue_stats", f"""WITH {JOBS_SQL} SELECT COALESCE(job_type, 'total') AS job_type, CAST(count(*) FILTER (WHERE status = 'pending') AS BIGINT) AS pending, CAST(count(*) FILTER (WHERE status = 'processing') AS BIGINT) AS processing, CAST(count(*) FILTER (WHERE status = 'done') AS BIGINT) AS done,
  strftime(min(run_at) FILTER (WHERE status = 'pending'), '%Y-%m-%d %H:%M:%S') AS next_run, CAST(count(*) FILTER (WHERE status = 'processing' AND started_at < TIMESTAMP '{AS_OF}' - INTERVAL 30 MINUTE) AS BIGINT) AS stuck FROM jobs GROUP BY GROUPING SETS ((job_type), ())""")
def queue_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per type and for all: counts by status, the next run, and jobs that have been running for over half an hour."""
    stuck = (F.col("status") == "processing") & (F.col("started_at") < F.lit(AS_OF).cast("timestamp_ntz") - F.expr("INTERVAL 30 MINUTES"))
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("pending", "processing", "done")]
    stats = frames.jobs(spark, sf_dir).rollup("job_type").agg(
        *counts, F.date_format(F.min(F.when(F.col("status") == "pending", F.col("run_at"))), "yyyy-MM-dd HH:mm:ss").alias("next_run"), F.count_if(stuck).alias("stuck")
    )
    return stats.withColumn("job_type", F.coalesce("job_type", F.lit("total")))


@query("a19_a20_a21_dashboard", """SELECT (SELECT CAST(count(*) AS BIGINT) FROM documents) AS documents, (SELECT CAST(count(*) AS BIGINT) FROM pages) AS pages, (SELECT CAST(count(*) FILTER (WHERE toxic = 1) AS BIGINT) FROM labels) AS toxic, (SELECT round(avg(quality), 6) FROM labels) AS quality,
  (SELECT round(COALESCE(sum(o_totalprice), 0), 2) FROM orders WHERE o_orderstatus = 'F') AS settled, (SELECT CAST(count(DISTINCT COALESCE(c_mktsegment, 'unknown')) AS BIGINT) FROM customer) AS segments""")
def dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        table(spark, sf_dir, "documents").agg(F.count("*").alias("documents")),
        table(spark, sf_dir, "pages").agg(F.count("*").alias("pages")),
        table(spark, sf_dir, "labels").agg(F.count_if(F.col("toxic") == 1).alias("toxic"), F.round(F.avg("quality"), 6).alias("quality")),
        table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").agg(F.round(F.coalesce(F.sum("o_totalprice"), F.lit(0.0)), 2).alias("settled")),
        table(spark, sf_dir, "customer").agg(F.countDistinct(F.coalesce("c_mktsegment", F.lit("unknown"))).alias("segments")),
    ]
    row = parts[0]
    for part in parts[1:]:
        row = row.join(F.broadcast(part))  # every part is one row
    return row


@query("a22_a23_runs", "SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS run, strftime(min(ts), '%H:%M:%S') AS started, round(sum(value), 4) AS duration, CAST(count(*) FILTER (WHERE event_type <> 'view') AS BIGINT) AS processed, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS failed FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 50")
def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("run")).agg(
        F.date_format(F.min("ts"), "HH:mm:ss").alias("started"), F.round(F.sum("value"), 4).alias("duration"),
        F.count_if(F.col("event_type") != "view").alias("processed"), F.count_if(F.col("event_type") == "error").alias("failed"),
    )
    return r.orderBy(F.col("run").desc()).limit(50)


@query("a24_c19_lifecycle", f"""WITH {ARTICLES_SQL} SELECT CASE WHEN published_at > TIMESTAMP '{AS_OF}' - INTERVAL 6 HOUR THEN 'emerging' WHEN published_at > TIMESTAMP '{AS_OF}' - INTERVAL 48 HOUR THEN 'growing' WHEN published_at > TIMESTAMP '{AS_OF}' - INTERVAL 120 HOUR THEN 'stable' ELSE 'stale' END AS state, CAST(count(*) AS BIGINT) AS n FROM articles GROUP BY 1""")
def lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.operators.scoring import lifecycle as state

    return frames.articles(spark, sf_dir).groupBy(state(F.col("published_at"), F.lit(AS_OF).cast("timestamp_ntz")).alias("state")).agg(F.count("*").alias("n"))


@query("a25_a26_a28_z07_quality", f"""WITH {ARTICLES_SQL}, s AS (SELECT title AS story, count(*) AS n, count(DISTINCT source_name) AS sources FROM articles GROUP BY 1)
SELECT CAST(count(*) FILTER (WHERE n = 1) AS BIGINT) AS single, CAST(count(*) FILTER (WHERE n BETWEEN 2 AND 5) AS BIGINT) AS some, CAST(count(*) FILTER (WHERE n >= 6) AS BIGINT) AS many, round(count(*) FILTER (WHERE n >= 2) / count(*), 6) AS clustered,
  round(count(*) FILTER (WHERE sources >= 2) / nullif(count(*) FILTER (WHERE n >= 2), 0), 6) AS multi_source, round(100 * (0.4 * count(*) FILTER (WHERE n >= 2) / count(*) + 0.3 * count(*) FILTER (WHERE sources >= 2) / nullif(count(*) FILTER (WHERE n >= 2), 0) + 0.3 * 1), 4) AS score FROM s""")
def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of stories (here texts with one title), and a score of clustering, sources and common entities."""
    s = frames.articles(spark, sf_dir).groupBy("title").agg(F.count("*").alias("n"), F.countDistinct("source_name").alias("sources"))
    pairs, multi = F.count_if(F.col("n") >= 2), F.count_if(F.col("sources") >= 2)
    clustered, share = pairs / F.count("*"), F.try_divide(multi, pairs)
    return s.agg(
        F.count_if(F.col("n") == 1).alias("single"), F.count_if(F.col("n").between(2, 5)).alias("some"), F.count_if(F.col("n") >= 6).alias("many"),
        F.round(clustered, 6).alias("clustered"), F.round(share, 6).alias("multi_source"), F.round(100 * (0.4 * clustered + 0.3 * share + 0.3 * F.lit(1)), 4).alias("score"),
    )


@query("a27_common_entities", f"""WITH {ARTICLES_SQL}, m AS (SELECT source_name AS story, count(*) AS n FROM articles GROUP BY 1), t AS (SELECT DISTINCT source_name AS story, id, unnest(string_split(lower(title), ' ')) AS entity FROM articles),
  c AS (SELECT story, entity, count(*) AS n FROM t GROUP BY 1, 2) SELECT m.story, CAST(count(c.entity) FILTER (WHERE c.n * 2 >= m.n) AS BIGINT) AS in_half, CAST(COALESCE(max(c.n), 0) AS BIGINT) AS most FROM m LEFT JOIN c USING (story) GROUP BY 1""")
def common_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities that at least half the articles of a group share."""
    a = frames.articles(spark, sf_dir).select(F.col("source_name").alias("story"), "id", F.array_distinct(F.split(F.lower("title"), " ")).alias("words"))
    sizes = a.groupBy("story").agg(F.count("*").alias("size"))
    c = a.select("story", F.explode("words").alias("entity")).groupBy("story", "entity").agg(F.count("*").alias("n"))
    return sizes.join(c, "story", "left").groupBy("story").agg(F.count_if(F.col("n") * 2 >= F.col("size")).alias("in_half"), F.coalesce(F.max("n"), F.lit(0)).alias("most"))


@query("a29_best_days", f"WITH {ARTICLES_SQL}, d AS (SELECT CAST(published_at AS DATE) AS day, title, count(*) AS n FROM articles GROUP BY 1, 2) SELECT strftime(day, '%Y-%m-%d') AS day, round(count(*) FILTER (WHERE n >= 2) / count(*), 6) AS rate FROM d GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def best_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = frames.articles(spark, sf_dir).groupBy(F.date_format("published_at", "yyyy-MM-dd").alias("day"), "title").agg(F.count("*").alias("n"))
    return d.groupBy("day").agg(F.round(F.count_if(F.col("n") >= 2) / F.count("*"), 6).alias("rate")).orderBy(F.col("rate").desc(), "day").limit(5)


@query("a30_golden_set", f"""WITH {ARTICLES_SQL}, {LINKS_SQL} SELECT l.story_id, CAST(count(*) AS BIGINT) AS articles, CAST(count(DISTINCT a.source_name) AS BIGINT) AS sources, round(avg(l.similarity), 6) AS similarity, md5(string_agg(a.title, '; ' ORDER BY a.id)) AS titles FROM links l JOIN articles a ON a.id = l.article_id GROUP BY 1""")
def golden_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = frames.links(spark, sf_dir).join(frames.articles(spark, sf_dir), F.col("article_id") == F.col("id"))
    titles = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "title"))), lambda x: x["title"]), "; ")
    return joined.groupBy("story_id").agg(F.count("*").alias("articles"), F.countDistinct("source_name").alias("sources"), F.round(F.avg("similarity"), 6).alias("similarity"), F.md5(titles).alias("titles"))


@query("a31_percentiles", "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, max(value) FILTER (WHERE k = floor(n * 0.5)) AS p50, max(value) FILTER (WHERE k = floor(n * 0.95)) AS p95, max(value) FILTER (WHERE k = floor(n * 0.99)) AS p99 FROM r GROUP BY 1")
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values at the places floor(n * p), not interpolated; found by counting values, so no group is gathered."""
    v = table(spark, sf_dir, "events").groupBy("event_type", "value").agg(F.count("*").alias("c"))
    group = Window.partitionBy("event_type")
    v = v.withColumns({"upto": F.sum("c").over(group.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)), "n": F.sum("c").over(group)})
    at = lambda p: F.min(F.when(F.col("upto") > F.floor(F.col("n") * p), F.col("value")))
    return v.groupBy("event_type").agg(at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"))


@query("a33_a35_confusion", """WITH p AS (SELECT d.doc_id, d.n_chars >= 500 AS said, l.quality = 1 AS truth FROM documents d JOIN labels l USING (doc_id)), c AS (SELECT count(*) FILTER (WHERE said AND truth) AS tp, count(*) FILTER (WHERE said AND NOT truth) AS fp, count(*) FILTER (WHERE NOT said AND truth) AS fn, count(*) FILTER (WHERE said) AS n FROM p)
SELECT round(CASE WHEN tp + fp = 0 THEN 1 ELSE tp / (tp + fp) END, 6) AS precision_share, round(CASE WHEN tp + fn = 0 THEN 1 ELSE tp / (tp + fn) END, 6) AS recall_share, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1, round(3.0 / n, 6) AS upper_bound FROM c""")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of a rule against labels; and 3 / n, the bound on a rate of which none was seen."""
    p = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select((F.col("n_chars") >= 500).alias("said"), (F.col("quality") == 1).alias("truth"))
    c = p.agg(F.count_if(F.col("said") & F.col("truth")).alias("tp"), F.count_if(F.col("said") & ~F.col("truth")).alias("fp"), F.count_if(~F.col("said") & F.col("truth")).alias("fn"), F.count_if("said").alias("n"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select(
        F.round(F.when(tp + fp == 0, 1.0).otherwise(F.try_divide(tp, tp + fp)), 6).alias("precision_share"), F.round(F.when(tp + fn == 0, 1.0).otherwise(F.try_divide(tp, tp + fn)), 6).alias("recall_share"),
        F.round(F.when(2 * tp + fp + fn == 0, 0.0).otherwise(F.try_divide(2 * tp, 2 * tp + fp + fn)), 6).alias("f1"), F.round(F.try_divide(F.lit(3.0), F.col("n")), 6).alias("upper_bound"),
    )


@query("a34_bands", "SELECT CASE WHEN value < 20 THEN '0-20' WHEN value < 50 THEN '20-50' WHEN value < 80 THEN '50-80' ELSE '80+' END AS band, event_type, CAST(count(*) AS BIGINT) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY event_type), 6) AS share FROM events GROUP BY 1, 2")
def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    band = F.when(F.col("value") < 20, "0-20").when(F.col("value") < 50, "20-50").when(F.col("value") < 80, "50-80").otherwise("80+")
    n = table(spark, sf_dir, "events").groupBy(band.alias("band"), "event_type").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("event_type")), 6))


@query("a36_a38_repeats", "SELECT user_id, event_type, min(event_id) AS first_id, CAST(count(*) AS BIGINT) AS occurrences, CAST(count(DISTINCT CAST(ts AS DATE)) AS BIGINT) AS days FROM events GROUP BY 1, 2 HAVING count(DISTINCT CAST(ts AS DATE)) > 1")
def repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_id"), F.count("*").alias("occurrences"), F.countDistinct(F.to_date("ts")).alias("days"))
    return r.filter("days > 1")


@query("a37_assignment_diff", f"""WITH {LINKS_SQL}, other AS (SELECT vec_id AS article_id, CASE WHEN vec_id % 10 = 0 THEN (label + 1) % 10 ELSE label END AS story_id FROM embeddings WHERE embedding[1] > -0.2)
SELECT CASE WHEN l.story_id IS NULL THEN 'no_original' WHEN o.story_id IS NULL THEN 'not_found' WHEN l.story_id = o.story_id THEN 'same' ELSE 'different' END AS outcome, CAST(count(*) AS BIGINT) AS n FROM documents d LEFT JOIN links l ON l.article_id = d.doc_id LEFT JOIN other o ON o.article_id = d.doc_id GROUP BY 1""")
def assignment_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How two assignments of articles to stories differ."""
    first = frames.links(spark, sf_dir).select("article_id", F.col("story_id").alias("was"))
    other = table(spark, sf_dir, "embeddings").filter(F.col("embedding")[0] > -0.2).select(F.col("vec_id").alias("article_id"), F.when(F.col("vec_id") % 10 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("now"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id")).join(first, "article_id", "left").join(other, "article_id", "left")
    outcome = F.when(F.col("was").isNull(), "no_original").when(F.col("now").isNull(), "not_found").when(F.col("was") == F.col("now"), "same").otherwise("different")
    return d.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query("a39_f29_frequent_words", f"WITH {ARTICLES_SQL}, w AS (SELECT id, unnest(list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda x: length(x) > 4))) AS word FROM articles) SELECT word, CAST(count(*) AS BIGINT) AS titles FROM w GROUP BY 1 HAVING count(*) >= 3")
def frequent_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = frames.articles(spark, sf_dir).select(F.explode(F.array_distinct(T.tokens(F.col("title"), 5))).alias("word"))
    return w.groupBy("word").agg(F.count("*").alias("titles")).filter("titles >= 3")


@query("a40_a45_pivot", "SELECT source, CAST(count(*) FILTER (WHERE lang = 'en') AS BIGINT) AS en, CAST(count(*) FILTER (WHERE lang = 'de') AS BIGINT) AS de, CAST(count(*) FILTER (WHERE lang = 'fr') AS BIGINT) AS fr, CAST(count(*) FILTER (WHERE lang = 'es') AS BIGINT) AS es FROM documents GROUP BY 1")
def pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").pivot("lang", ["en", "de", "fr", "es"]).count().fillna(0)


@query("a41_z06_completeness", "SELECT source, CAST(count(*) AS BIGINT) AS total, CAST(count(e.vec_id) AS BIGINT) AS with_embedding, round(100.0 * count(e.vec_id) / count(*), 4) AS percent, CAST(count(*) FILTER (WHERE l.quality IS NULL) AS BIGINT) AS unlabelled FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1")
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "vec_id"), "doc_id", "left")
    d = d.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    n = F.count("vec_id")
    return d.groupBy("source").agg(F.count("*").alias("total"), n.alias("with_embedding"), F.round(100.0 * n / F.count("*"), 4).alias("percent"), F.count_if(F.col("quality").isNull()).alias("unlabelled"))


@query("a43_name_collisions", "SELECT regexp_extract(p_name, '([a-z]+)$', 1) AS suffix, CAST(count(DISTINCT p_brand) AS BIGINT) AS brands, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1")
def name_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "part").groupBy(F.regexp_extract("p_name", "([a-z]+)$", 1).alias("suffix")).agg(F.countDistinct("p_brand").alias("brands"), F.count("*").alias("n"))
    return c.filter("brands > 1")


@query("a46_z15_z16_story_sizes", f"WITH {ARTICLES_SQL}, {LINKS_SQL}, {STORIES_SQL} SELECT id, source_count, source_count = 1 AS single, strftime(last_article_at, '%Y-%m-%d %H') AS last_seen FROM stories ORDER BY last_article_at DESC, id LIMIT 50")
def story_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = frames.stories(spark, sf_dir).orderBy(F.col("last_article_at").desc_nulls_last(), "id").limit(50)
    return s.select("id", "source_count", (F.col("source_count") == 1).alias("single"), F.date_format("last_article_at", "yyyy-MM-dd HH").alias("last_seen"))


@query("t14_d15_priority_sample", """WITH r AS (SELECT event_id, event_type, value, round(greatest(0, (50 - value) * 0.1) + CASE event_type WHEN 'error' THEN 5 WHEN 'click' THEN 1 ELSE 0 END + CASE WHEN user_id > 100 THEN 2 ELSE 0 END, 2) AS risk FROM events),
  k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY risk DESC, event_id) AS n, row_number() OVER (ORDER BY md5('7|' || event_id), event_id) AS draw FROM r)
SELECT event_id, risk, CASE WHEN n <= 9 THEN 'priority' ELSE 'baseline' END AS stratum FROM k WHERE n <= 9 OR draw <= 15""")
def priority_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The riskiest of every type, and a seeded draw over all rows."""
    risk = F.greatest(F.lit(0.0), (50 - F.col("value")) * 0.1) + F.when(F.col("event_type") == "error", 5).when(F.col("event_type") == "click", 1).otherwise(0) + F.when(F.col("user_id") > 100, 2).otherwise(0)
    r = table(spark, sf_dir, "events").select("event_id", "event_type", F.round(risk, 2).alias("risk"))
    first = r.withColumn("n", F.row_number().over(Window.partitionBy("event_type").orderBy(F.col("risk").desc(), "event_id"))).filter("n <= 9")
    drawn = r.orderBy(F.md5(F.concat(F.lit("7|"), F.col("event_id").cast("string"))), "event_id").limit(15)
    first = first.select("event_id", "risk", F.lit("priority").alias("stratum"))
    return first.unionByName(drawn.join(first, "event_id", "left_anti").select("event_id", "risk", F.lit("baseline").alias("stratum")))


@query("c24_threshold_sweep", "WITH t(level) AS (VALUES (200), (500), (1000), (5000)), p AS (SELECT d.n_chars, l.quality FROM documents d JOIN labels l USING (doc_id)) SELECT CAST(level AS INTEGER) AS level, CAST(count(*) FILTER (WHERE n_chars >= level) AS BIGINT) AS said, round(count(*) FILTER (WHERE n_chars >= level AND quality = 1) / nullif(count(*) FILTER (WHERE n_chars >= level), 0), 6) AS precision_share FROM p, t GROUP BY 1")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass for all thresholds: each row counts for those that it reaches."""
    levels = F.array(*map(F.lit, (200, 500, 1000, 5000)))
    p = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("n_chars", "quality", F.explode(levels).alias("level"))
    said = F.col("n_chars") >= F.col("level")
    return p.groupBy("level").agg(F.count_if(said).alias("said"), F.round(F.try_divide(F.count_if(said & (F.col("quality") == 1)), F.count_if(said)), 6).alias("precision_share"))
