"""Reports as queries: queues, dashboards, runs, reviews, clustering quality, spending and upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import reports as R
from weftline.plans.clustering import WORDS_SQL
from weftline.plans.registry import query
from weftline.sources import frames
from weftline.sources.frames import ARTICLES_SQL, AS_OF, JOBS_SQL, LINKS_SQL, STORIES_SQL, table

STAMP = "yyyy-MM-dd HH:mm:ss"
NOW = f"TIMESTAMP '{AS_OF}'"
MEMBERS_SQL = f"{ARTICLES_SQL}, {LINKS_SQL}, m AS (SELECT l.story_id AS story, a.id AS article, a.source_name AS source, list_sort({WORDS_SQL.format('a.title')}) AS entities FROM links l JOIN articles a ON a.id = l.article_id)"


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of stories with their sources and title words as entities."""
    joined = frames.links(spark, sf_dir).join(frames.articles(spark, sf_dir), F.col("article_id") == F.col("id"))
    return joined.select(F.col("story_id").alias("story"), F.col("id").alias("article"), F.col("source_name").alias("source"), F.array_sort(F.array_distinct(T.tokens(F.col("title"), 4))).alias("entities"))


@query("a18_queue_ages", f"""WITH {JOBS_SQL}, s AS (SELECT COALESCE(job_type, 'total') AS job_type, CAST(count(*) FILTER (WHERE status = 'pending') AS BIGINT) AS pending, CAST(count(*) FILTER (WHERE status = 'processing') AS BIGINT) AS processing, CAST(count(*) FILTER (WHERE status = 'done') AS BIGINT) AS done, CAST(count(*) FILTER (WHERE status = 'failed') AS BIGINT) AS failed, min(run_at) FILTER (WHERE status = 'pending') AS next FROM jobs GROUP BY GROUPING SETS ((job_type), ()))
SELECT job_type, pending, processing, done, failed, strftime(next, '%Y-%m-%d %H:%M:%S') AS next_run, CAST(greatest(COALESCE(floor(epoch({NOW} - next) / 60), 0), 0) AS BIGINT) AS age_minutes, COALESCE(epoch({NOW} - next) / 60 > 30, false) AS is_stuck FROM s""")
def queue_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = R.queue_stats(frames.jobs(spark, sf_dir), AS_OF)
    return s.select(F.coalesce("job_type", F.lit("total")).alias("job_type"), "pending", "processing", "done", "failed", F.date_format("next_run_at", STAMP).alias("next_run"), "age_minutes", "is_stuck")


_REVIEWS = {"pardons": ("orders", "o_orderkey"), "rulings": ("part", "p_partkey"), "decrees": ("customer", "c_custkey")}
_REVIEW_SQL = ", ".join(f"(SELECT CAST(count(*) AS BIGINT) AS {n}_total, CAST(count(*) FILTER (WHERE {k} % 3 = 0) AS BIGINT) AS {n}_published, CAST(count(*) FILTER (WHERE {k} % 3 = 1) AS BIGINT) AS {n}_draft, CAST(count(*) FILTER (WHERE {k} % 5 = 0) AS BIGINT) AS {n}_review FROM {t})" for n, (t, k) in _REVIEWS.items())


@query("a19_snapshot", f"""WITH {ARTICLES_SQL}, {LINKS_SQL}, {STORIES_SQL},
  st AS (SELECT CAST(count(*) AS BIGINT) AS stories, CAST(count(*) FILTER (WHERE last_article_at >= {NOW} - INTERVAL 7 DAY) AS BIGINT) AS stories_active, CAST(count(*) FILTER (WHERE source_count < 2) AS BIGINT) AS stories_review, CAST(count(*) FILTER (WHERE CAST(first_seen_at AS DATE) = CAST({NOW} AS DATE)) AS BIGINT) AS stories_today FROM stories),
  ar AS (SELECT CAST(count(*) AS BIGINT) AS articles, CAST(count(*) FILTER (WHERE CAST(published_at AS DATE) = CAST({NOW} AS DATE)) AS BIGINT) AS articles_today, max(published_at) AS last FROM articles),
  fe AS (SELECT CAST(count(*) AS BIGINT) AS feeds, CAST(count(*) FILTER (WHERE s_suppkey % 4 <> 0 AND s_suppkey % 7 < 5) AS BIGINT) AS active, CAST(count(*) FILTER (WHERE s_suppkey % 4 <> 0 AND s_suppkey % 7 BETWEEN 1 AND 4) AS BIGINT) AS degraded, CAST(count(*) FILTER (WHERE s_suppkey % 7 >= 5) AS BIGINT) AS failed FROM supplier),
  bu AS (SELECT round(sum(value) FILTER (WHERE event_type = 'purchase'), 4) AS spent, CAST(count(*) FILTER (WHERE event_type = 'purchase') AS BIGINT) AS calls FROM events)
SELECT st.*, articles, articles_today, fe.*, {", ".join(f"{n}_{x}" for n in _REVIEWS for x in ("total", "published", "draft", "review"))}, COALESCE(spent, 0) AS spent, calls, round(100 * COALESCE(spent, 0) / 50000.0, 4) AS budget_pct, CAST(floor(epoch({NOW} - last) / 60) AS BIGINT) AS minutes_since, CASE WHEN last IS NULL THEN 'unknown' WHEN floor(epoch({NOW} - last) / 60) < 150 THEN 'ok' WHEN floor(epoch({NOW} - last) / 60) < 240 THEN 'warning' ELSE 'error' END AS pipeline FROM st, ar, fe, bu, {_REVIEW_SQL}""")
def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All figures of the admin page in one row: stories, articles, feeds, three kinds of reviewed records, the budget and the pipeline's status."""
    now = F.lit(AS_OF).cast("timestamp_ntz")
    today = lambda c: F.to_date(c) == F.to_date(now)
    stories = frames.stories(spark, sf_dir).agg(
        F.count("*").alias("stories"), F.count_if(F.col("last_article_at") >= now - F.expr("INTERVAL 7 DAYS")).alias("stories_active"), F.count_if(F.expr("source_count < 2")).alias("stories_review"), F.count_if(today("first_seen_at")).alias("stories_today"),
    )
    articles = frames.articles(spark, sf_dir).agg(F.count("*").alias("articles"), F.count_if(today("published_at")).alias("articles_today"), F.max("published_at").alias("last"))
    feeds = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 4 != 0).alias("is_active"), (F.col("s_suppkey") % 7).alias("failures"))
    reviewed = []
    for name, (source, key) in _REVIEWS.items():
        rest = F.col(key) % 3
        flags = table(spark, sf_dir, source).select(F.when(rest == 0, True).when(rest == 1, False).alias("is_public"), (F.col(key) % 5 == 0).alias("needs_review"))
        reviewed.append(R.review_counts(flags, name))
    bought = F.col("event_type") == "purchase"
    budget = table(spark, sf_dir, "events").agg(F.coalesce(F.round(F.sum(F.when(bought, F.col("value"))), 4), F.lit(0.0)).alias("spent"), F.count_if(bought).alias("calls"))
    row = R.side_by_side([stories, articles, R.feed_counts(feeds), *reviewed, budget])
    added = {"budget_pct": F.round(100 * F.col("spent") / 50000.0, 4), "minutes_since": R.minutes_since(F.col("last"), AS_OF), "pipeline": R.pipeline_status(F.col("last"), AS_OF)}
    return row.withColumns(added).drop("last")


@query("a20_pardon_stats", """SELECT facet, value, n, amount FROM (SELECT 'all' AS facet, 'total' AS value, CAST(count(*) AS BIGINT) AS n, round(COALESCE(sum(o_totalprice), 0), 2) AS amount FROM orders UNION ALL SELECT 'all', 'reoffended', CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT), round(COALESCE(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 0), 2) FROM orders
  UNION ALL SELECT 'connection', COALESCE(nullif(o_orderpriority, '4-NOT SPECIFIED'), 'unknown'), CAST(count(*) AS BIGINT), round(COALESCE(sum(o_totalprice), 0), 2) FROM orders GROUP BY 2)""")
def pardon_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals, those that reoffended, donations, and a breakdown by connection, unknown where it is missing."""
    o = table(spark, sf_dir, "orders").select("o_totalprice", F.col("o_orderstatus") == "F", F.coalesce(F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")), F.lit("unknown"))).toDF("amount", "again", "connection")
    kinds = F.array(
        F.struct(F.lit("all").alias("facet"), F.lit("total").alias("value"), F.lit(True).alias("here")), F.struct(F.lit("all").alias("facet"), F.lit("reoffended").alias("value"), F.col("again").alias("here")),
        F.struct(F.lit("connection").alias("facet"), F.col("connection").alias("value"), F.lit(True).alias("here")),
    )
    each = o.select("amount", F.explode(kinds).alias("k"))
    amount = F.round(F.coalesce(F.sum(F.when(F.col("k.here"), F.col("amount"))), F.lit(0.0)), 2)
    return each.groupBy("k.facet", "k.value").agg(F.count_if("k.here").alias("n"), amount.alias("amount"))


_ALARM_SQL = "SELECT event_type AS type, CAST(event_id % 6 AS INTEGER) AS alarm, CASE WHEN value < 10 THEN 'small' WHEN value < 100 THEN 'middle' END AS category, event_id % 3 = 0 AS active FROM events"


@query("a21_client_stats", f"""WITH e AS ({_ALARM_SQL}) SELECT 'type' AS facet, type AS value, CAST(count(*) AS BIGINT) AS n FROM e GROUP BY 2 UNION ALL SELECT 'alarm', CAST(alarm AS VARCHAR), CAST(count(*) AS BIGINT) FROM e GROUP BY 2 UNION ALL SELECT 'category', category, CAST(count(*) AS BIGINT) FROM e GROUP BY 2
  UNION ALL SELECT 'summary', 'total', CAST(count(*) AS BIGINT) FROM e UNION ALL SELECT 'summary', 'active', CAST(count(*) FILTER (WHERE active) AS BIGINT) FROM e UNION ALL SELECT 'summary', 'severe', CAST(count(*) FILTER (WHERE alarm >= 4) AS BIGINT) FROM e UNION ALL SELECT 'summary', 'avg_alarm_milli', CAST(COALESCE(round(1000 * avg(alarm)), 0) AS BIGINT) FROM e""")
def client_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("value")
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("type"), (F.col("event_id") % 6).cast("int").alias("alarm"), F.when(value < 10, "small").when(value < 100, "middle").alias("category"), (F.col("event_id") % 3 == 0).alias("active"))
    s = e.agg(F.count("*").alias("total"), F.count_if("active").alias("active"), F.count_if(F.expr("alarm >= 4")).alias("severe"), F.coalesce(F.round(1000 * F.avg("alarm")), F.lit(0)).cast("long").alias("avg_alarm_milli"))
    summary = s.unpivot([], s.columns, "value", "n").select(F.lit("summary").alias("facet"), "value", "n")
    return R.facets(e, ["type", "alarm", "category"]).unionByName(summary)


@query("a22_run_rollup", """WITH l AS (SELECT 'run-' || (user_id % 97) AS run_id, CASE event_type WHEN 'view' THEN 'running' WHEN 'error' THEN 'failed' ELSE 'completed' END AS status, CASE WHEN event_id % 13 > 0 THEN value END AS duration, event_id % 11 = 0 AS needs_review, ts AS created_at FROM events)
SELECT run_id, strftime(min(created_at), '%Y-%m-%d %H:%M:%S') AS started_at, round(sum(COALESCE(duration, 0)), 4) AS duration, CAST(count(*) FILTER (WHERE status <> 'running') AS BIGINT) AS processed, CAST(count(*) FILTER (WHERE needs_review) AS BIGINT) AS flagged, CAST(count(*) FILTER (WHERE status = 'running') AS BIGINT) AS running, CAST(count(*) FILTER (WHERE status = 'completed') AS BIGINT) AS completed, CAST(count(*) FILTER (WHERE status = 'failed') AS BIGINT) AS failed
FROM l GROUP BY 1 ORDER BY min(created_at) DESC, 1 LIMIT 50""")
def run_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "view", "running").when(F.col("event_type") == "error", "failed").otherwise("completed")
    log = e.select(F.concat(F.lit("run-"), (F.col("user_id") % 97).cast("string")).alias("run_id"), status.alias("status"), F.when(F.col("event_id") % 13 > 0, F.col("value")).alias("duration"), (F.col("event_id") % 11 == 0).alias("needs_review"), F.col("ts").alias("created_at"))
    return R.run_rollup(log).withColumns({"started_at": F.date_format("started_at", STAMP), "duration": F.round("duration", 4)})


@query("a23_p14_tabs", """WITH latest AS (SELECT event_id % 1000 AS id, arg_max(event_type, {'ts': ts, 'id': event_id}) AS status FROM events GROUP BY 1), r AS (SELECT p_partkey AS id, p_partkey % 2 = 0 AS enriched, p_partkey % 3 = 0 AS is_public, p_partkey % 5 = 0 AS needs_review, CASE WHEN status = 'error' THEN 'failed' ELSE status END AS latest FROM part LEFT JOIN latest ON latest.id = p_partkey WHERE p_size > 10)
SELECT CAST(count(*) FILTER (WHERE enriched AND NOT is_public AND needs_review) AS BIGINT) AS needs_review, CAST(count(*) FILTER (WHERE NOT enriched) AS BIGINT) AS unenriched, CAST(count(*) FILTER (WHERE enriched AND NOT is_public) AS BIGINT) AS unpublished, CAST(count(*) FILTER (WHERE is_public) AS BIGINT) AS published, CAST(count(*) FILTER (WHERE NOT enriched AND latest = 'failed') AS BIGINT) AS failed, CAST(count(*) AS BIGINT) AS "all" FROM r""")
def tab_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the six tabs over one filtered scan, joined with the latest log entry of each record."""
    latest = table(spark, sf_dir, "events").groupBy((F.col("event_id") % 1000).alias("log_id")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"))
    rows = table(spark, sf_dir, "part").filter("p_size > 10").join(latest, F.col("p_partkey") == F.col("log_id"), "left")
    k = F.col("p_partkey")
    state = {"enriched": k % 2 == 0, "is_public": k % 3 == 0, "needs_review": k % 5 == 0, "latest": F.when(F.col("status") == "error", "failed").otherwise(F.col("status"))}
    return rows.agg(*(F.count_if(c).alias(name) for name, c in R.tabs(state).items()))


@query("a16_nested_skips", "WITH c AS (SELECT event_type AS pipeline, CAST(CAST(floor(value) AS BIGINT) % 5 AS BIGINT) AS reason, count(*) AS n FROM events GROUP BY 1, 2) SELECT pipeline, CAST(sum(n) AS BIGINT) AS total, '[' || string_agg('{\"reason\":' || reason || ',\"n\":' || n || '}', ',' ORDER BY n DESC, reason) || ']' AS reasons FROM c GROUP BY 1")
def nested_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("pipeline"), (F.floor("value") % 5).alias("reason"))
    return R.nested_counts(e, "pipeline", "reason").select("pipeline", "total", F.to_json(F.transform("parts", lambda x: F.struct(x["value"].alias("reason"), x["n"].alias("n")))).alias("reasons"))


@query("a17_verdicts", """WITH l AS (SELECT event_id AS id, nullif(event_type, 'view') AS verdict, event_id % 4 = 0 AS merged, ts AS created_at FROM events), n AS (SELECT * FROM l ORDER BY created_at DESC, id DESC LIMIT 5000)
SELECT verdict, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE merged) AS BIGINT) AS merged, (SELECT count(*) > 5000 FROM l) AS truncated FROM n WHERE verdict IS NOT NULL GROUP BY 1""")
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of the newest 5,000 entries, the report's own limit, and whether there are more."""
    log = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.nullif("event_type", F.lit("view")).alias("verdict"), (F.col("event_id") % 4 == 0).alias("merged"), F.col("ts").alias("created_at"))
    return R.verdict_counts(log, 5000)


@query("a27_a28_clustering_quality", f"""WITH {ARTICLES_SQL}, m AS (SELECT md5(substr(title, 1, 12)) AS story, id AS article, source_name AS source, list_sort({WORDS_SQL.format('title')}) AS entities FROM articles), s AS (SELECT story, count(DISTINCT article) AS n, count(DISTINCT source) AS sources FROM m GROUP BY 1), q AS (SELECT story, n FROM s WHERE n >= 2 ORDER BY story LIMIT 20),
  e AS (SELECT DISTINCT m.story, q.n, article, unnest(entities) AS entity FROM m JOIN q USING (story)), c AS (SELECT DISTINCT story FROM (SELECT story, n, entity, count(*) AS k FROM e GROUP BY 1, 2, 3) WHERE k = n), r AS (SELECT CAST(count(*) AS BIGINT) AS stories, CAST(count(*) FILTER (WHERE n >= 2) AS BIGINT) AS clustered, CAST(count(*) FILTER (WHERE n >= 2 AND sources >= 2) AS BIGINT) AS multi_source, (SELECT CAST(count(*) AS BIGINT) FROM q) AS asked, (SELECT CAST(count(*) AS BIGINT) FROM c) AS common FROM s)
SELECT *, round(100 * (0.4 * COALESCE(clustered / nullif(stories, 0), 0) + 0.3 * COALESCE(multi_source / nullif(clustered, 0), 0) + 0.3 * COALESCE(common / nullif(asked, 0), 0)), 4) AS score FROM r""")
def clustering_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that begin alike as stories; the score's third part is the share of stories whose articles all share an entity."""
    a = frames.articles(spark, sf_dir)
    m = a.select(F.md5(F.substring("title", 1, 12)).alias("story"), F.col("id").alias("article"), F.col("source_name").alias("source"), F.array_sort(F.array_distinct(T.tokens(F.col("title"), 4))).alias("entities"))
    return R.clustering_quality(m).withColumn("score", F.round("score", 4))


LEVELS = (0.2, 0.4, 0.6, 0.8)


@query("a35_threshold_table", f"""WITH p AS (SELECT (vec_id % 100) / 100.0::DOUBLE AS sim, CASE WHEN vec_id % 100 > 85 THEN 's' WHEN vec_id % 3 = 0 THEN 'S' WHEN vec_id % 3 = 1 THEN 'a' ELSE 'D' END AS label FROM embeddings), t AS (SELECT unnest({list(LEVELS)}::DOUBLE[]) AS threshold), c AS (SELECT threshold, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE upper(label) = 'S') AS BIGINT) AS correct, CAST(count(*) FILTER (WHERE upper(label) = 'D') AS BIGINT) AS false_strict, CAST(count(*) FILTER (WHERE upper(label) IN ('A', 'D')) AS BIGINT) AS false_wide FROM p JOIN t ON sim >= threshold GROUP BY 1)
SELECT *, CASE WHEN false_strict = 0 THEN round(300 / n, 1) END AS upper_bound FROM c""")
def threshold_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("vec_id")
    label = F.when(k % 100 > 85, "s").when(k % 3 == 0, "S").when(k % 3 == 1, "a").otherwise("D")
    return R.threshold_table(table(spark, sf_dir, "embeddings").select(((k % 100) / 100.0).alias("sim"), label.alias("label")), LEVELS)


@query("d15_t14_review_sample", f"""WITH l AS (SELECT *, (vec_id % 90) / 100.0::DOUBLE AS sim, (vec_id % 6 * 8)::DOUBLE AS hours, ['slug', 'entity', 'title_only'][CAST(vec_id % 3 + 1 AS INTEGER)] AS reason, CASE WHEN vec_id % 4 > 0 THEN (vec_id % 8) / 100.0::DOUBLE END AS margin, CAST(vec_id % 14 AS INTEGER) AS candidates FROM embeddings),
  r AS (SELECT *, round(greatest(0, (0.92 - sim) * 10) + hours / 48 * 3 + CASE reason WHEN 'title_only' THEN 5 WHEN 'entity' THEN 1 ELSE 0 END + CASE WHEN candidates >= 2 AND margin < 0.03 THEN 3 ELSE 0 END + CASE WHEN candidates > 10 THEN 2 ELSE 0 END, 2) AS risk FROM l),
  p AS (SELECT *, CASE WHEN reason = 'title_only' THEN 0 WHEN margin < 0.03 THEN 1 WHEN hours > 30 THEN 2 END AS place FROM r), k AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY risk DESC, vec_id) AS n FROM p WHERE place IS NOT NULL), c AS (SELECT vec_id, risk, ['title_only', 'small_margin', 'late'][CAST(place + 1 AS INTEGER)] AS stratum FROM k WHERE n <= [20, 15, 15][CAST(place + 1 AS INTEGER)] ORDER BY place, n LIMIT 45)
SELECT * FROM c UNION ALL (SELECT vec_id, risk, 'baseline' FROM r WHERE vec_id NOT IN (SELECT vec_id FROM c) ORDER BY md5('42|' || vec_id), vec_id LIMIT 15)""")
def review_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A budget of 45 risky decisions from three strata, and a baseline of 15 others in seeded order; both are the report's own limits."""
    k = F.col("vec_id")
    reason = F.element_at(F.array(F.lit("slug"), F.lit("entity"), F.lit("title_only")), (k % 3 + 1).cast("int"))
    r = table(spark, sf_dir, "embeddings").select("vec_id", ((k % 90) / 100.0).alias("sim"), (k % 6 * 8).cast("double").alias("hours"), reason.alias("reason"), F.when(k % 4 > 0, (k % 8) / 100.0).alias("margin"), (k % 14).cast("int").alias("candidates"))
    r = r.withColumn("risk", R.risk_score(*(F.col(c) for c in ("sim", "hours", "reason", "margin", "candidates"))))
    strata = [("title_only", F.col("reason") == "title_only", 20), ("small_margin", F.col("margin") < 0.03, 15), ("late", F.col("hours") > 30, 15)]
    return R.priority_sample(r, strata, [F.col("risk").desc()], 45, 15, 42, "vec_id").select("vec_id", "risk", "stratum")


@query("a42_spend_trend", f"""WITH d AS (SELECT CAST(ts AS DATE) AS day, sum(value) AS spent FROM events GROUP BY 1), t AS (SELECT COALESCE(avg(spent) FILTER (WHERE DATE '{AS_OF[:10]}' - day BETWEEN 0 AND 2), 0) AS r, COALESCE(avg(spent) FILTER (WHERE DATE '{AS_OF[:10]}' - day BETWEEN 3 AND 16), 0) AS b FROM d)
SELECT round(r, 4) AS recent_avg, round(b, 4) AS baseline_avg, round((r - b) * 30, 4) AS projected_delta, CASE WHEN b = 0 THEN 'no baseline' WHEN (r - b) / b > 0.5 THEN 'alert' WHEN (r - b) / b > 0.2 THEN 'watch' ELSE 'ok' END AS band FROM t""")
def spend_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.sum("value").alias("spent"))
    row = R.spend_trend(days, AS_OF)
    return row.select(*(F.round(c, 4).alias(c) for c in ("recent_avg", "baseline_avg", "projected_delta")), "band")


@query("a41_missing_fields", "WITH d AS (SELECT doc_id, CASE WHEN doc_id % 7 > 0 THEN lang END AS lang, CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE source END AS source, text FROM documents) SELECT doc_id, concat_ws(',', CASE WHEN trim(COALESCE(text, '')) = '' THEN 'text' END, CASE WHEN trim(COALESCE(lang, '')) = '' THEN 'lang' END, CASE WHEN trim(COALESCE(source, '')) = '' THEN 'source' END) AS missing, round(100 * (1 - (CASE WHEN trim(COALESCE(text, '')) = '' THEN 1 ELSE 0 END + CASE WHEN trim(COALESCE(lang, '')) = '' THEN 1 ELSE 0 END + CASE WHEN trim(COALESCE(source, '')) = '' THEN 1 ELSE 0 END) / 3), 1) AS complete FROM d")
def missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    d = table(spark, sf_dir, "documents").withColumns({"lang": F.when(k % 7 > 0, F.col("lang")), "source": F.when(k % 5 == 0, " ").otherwise(F.col("source"))})
    return R.missing_fields(d, "doc_id", ["text", "lang", "source"])


@query("c25_c30_upkeep", f"""WITH {ARTICLES_SQL}, {LINKS_SQL}, {STORIES_SQL}, {JOBS_SQL}, s AS (SELECT id, CASE WHEN id % 4 = 0 THEN 'hidden' WHEN id % 2 = 0 THEN 'closed' ELSE 'active' END AS status, first_seen_at + to_days(CAST(id * 3 AS INTEGER)) AS seen FROM stories), c AS (SELECT id, seen, CASE WHEN status = 'active' AND epoch({NOW} - seen) / 3600 > 72 THEN 'closed' ELSE status END AS status FROM s)
SELECT 'story' AS kind, CAST(id AS BIGINT) AS id, CASE WHEN status = 'closed' AND epoch({NOW} - seen) / 3600 > 168 THEN 'archived' ELSE status END AS status FROM c UNION ALL SELECT 'job', id, 'removed' FROM (SELECT id FROM jobs WHERE processed_at IS NOT NULL AND created_at < {NOW} - INTERVAL 30 DAY ORDER BY created_at, id LIMIT 10000)""")
def upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories closed after 72 hours and archived after 7 days, and finished jobs to remove after 30 days, at most 10,000 in one run."""
    s = frames.stories(spark, sf_dir)
    status = F.when(F.col("id") % 4 == 0, "hidden").when(F.col("id") % 2 == 0, "closed").otherwise("active")
    s = s.select("id", status.alias("status"), (F.col("first_seen_at") + F.make_dt_interval(days=F.col("id") * 3)).alias("first_seen_at"))
    stories = R.close_and_archive(s, AS_OF).select(F.lit("story").alias("kind"), F.col("id").cast("long").alias("id"), "status")
    return stories.unionByName(R.removable_jobs(frames.jobs(spark, sf_dir), AS_OF).select(F.lit("job").alias("kind"), "id", F.lit("removed").alias("status")))


@query("a38_slug_fragmentation", f"WITH {MEMBERS_SQL}, s AS (SELECT story, nullif(upper(array_to_string(entities[1:2], '-')), '') AS slug FROM m) SELECT slug, CAST(count(DISTINCT story) AS BIGINT) AS stories, CAST(count(*) AS BIGINT) AS articles FROM s WHERE slug IS NOT NULL GROUP BY 1 HAVING count(DISTINCT story) > 1")
def slug_fragmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    slug = F.nullif(F.upper(F.array_join(F.slice("entities", 1, 2), "-")), F.lit(""))
    return R.slug_fragmentation(members(spark, sf_dir).select("story", slug.alias("slug")))


@query("a14_v12_top_eight", f"WITH {MEMBERS_SQL}, v AS (SELECT DISTINCT story, article, unnest(entities) AS entity FROM m), c AS (SELECT story, entity, count(*) AS n FROM v GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY story ORDER BY n DESC, entity) AS k FROM c) SELECT story, string_agg(entity || ':' || n, ',' ORDER BY k) AS top FROM k WHERE k <= 8 GROUP BY 1")
def top_eight(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = F.transform("top", lambda x: F.concat(x["entity"], F.lit(":"), x["n"].cast("string")))
    return R.top_counters(members(spark, sf_dir)).select("story", F.array_join(top, ",").alias("top"))


@query("c19_lifecycle_fallback", f"""WITH {ARTICLES_SQL}, {LINKS_SQL}, {STORIES_SQL}, s AS (SELECT id, CASE WHEN id % 5 = 0 THEN last_article_at END AS range_upper, CASE WHEN id % 5 = 1 THEN last_article_at - INTERVAL 10 HOUR END AS last_article, CASE WHEN id % 5 = 2 THEN last_article_at - INTERVAL 50 HOUR END AS updated, CASE WHEN id % 5 = 3 THEN last_article_at - INTERVAL 130 HOUR END AS first_seen, CASE WHEN id % 2 = 0 THEN 'growing' ELSE 'stale' END AS old FROM stories),
  l AS (SELECT *, COALESCE(range_upper, last_article, updated, first_seen, TIMESTAMP '1970-01-01 00:00:00') AS last_at FROM s), n AS (SELECT *, epoch({NOW} - last_at) / 3600 AS h FROM l), t AS (SELECT *, CASE WHEN h < 6 THEN 'emerging' WHEN h < 48 THEN 'growing' WHEN h < 120 THEN 'stable' ELSE 'stale' END AS new FROM n) SELECT id, old, new, old <> new AS changed FROM t""")
def lifecycle_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States by the first known time of a story, and whether they change what is stored."""
    from weftline.operators.scoring import lifecycle, time_anchor

    last = F.col("last_article_at")
    when = lambda k, h: F.when(F.col("id") % 5 == k, last - F.expr(f"INTERVAL {h} HOURS"))
    at = time_anchor(("range", when(0, 0)), ("article", when(1, 10)), ("updated", when(2, 50)), ("seen", when(3, 130)), ("ancient", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")))["at"]
    s = frames.stories(spark, sf_dir).select("id", F.when(F.col("id") % 2 == 0, "growing").otherwise("stale").alias("old"), lifecycle(at, F.lit(AS_OF).cast("timestamp_ntz")).alias("new"))
    return s.withColumn("changed", F.col("old") != F.col("new"))
