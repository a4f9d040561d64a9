"""Predicates, joins, set operations, windows, sorts and pages as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import paging, queue
from weftline.plans.registry import query
from weftline.sources import frames
from weftline.sources.frames import ARTICLES_SQL, AS_OF, JOBS_SQL, LINKS_SQL, STORIES_SQL, table


@query("p01_p04_filters", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_totalprice >= 1000 AND o_totalprice < 300000 AND (o_orderpriority = '1-URGENT' OR (o_orderpriority <> '5-LOW' AND o_orderdate >= TIMESTAMP '1996-01-01'))")
def filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    urgent = (F.col("o_orderpriority") == "1-URGENT") | ((F.col("o_orderpriority") != "5-LOW") & (F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp")))
    return o.filter(F.col("o_orderstatus").isin("O", "P") & (F.col("o_totalprice") >= 1000) & (F.col("o_totalprice") < 300000) & urgent).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("p02_p16_nulls", "WITH d AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE lang END AS was, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE lang END AS now FROM documents) SELECT doc_id, was IS NULL AS missing, was IS DISTINCT FROM now AS changed FROM d WHERE now IS NOT NULL OR was IS NOT NULL")
def nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 7 != 0, F.col("lang")).alias("was"), F.when(F.col("doc_id") % 5 != 0, F.col("lang")).alias("now"))
    return d.filter("now is not null or was is not null").select("doc_id", F.col("was").isNull().alias("missing"), (~F.col("was").eqNullSafe(F.col("now"))).alias("changed"))


@query("p05_p12_p18_search", f"WITH {ARTICLES_SQL} SELECT id FROM articles WHERE title ILIKE '%the%' OR source_name ILIKE '%the%' OR (contains(lower(content), 'license') AND lang = 'en') OR id = 42")
def search(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = frames.articles(spark, sf_dir)
    found = paging.ilike_any(["title", "source_name"], "the") | (F.lower("content").contains("license") & (F.col("lang") == "en"))
    return a.filter(found | paging.mixed_search("id", ["lang"], "42")).select("id")


TAGS = "list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: length(w) >= 4))"


@query("p06_p08_arrays", f"WITH {ARTICLES_SQL}, t AS (SELECT id, {TAGS} AS tags FROM articles) SELECT id, list_has_any(tags, ['that', 'with', 'dans', 'sich']) AS overlaps, list_contains(tags, 'with') AS has_with, CAST(len(list_filter(tags, lambda w: w <> 'that' AND w <> 'with')) AS INTEGER) AS rest FROM t")
def arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = frames.articles(spark, sf_dir).select("id", F.array_distinct(T.tokens(F.col("title"), 4)).alias("tags"))
    stop = F.array(F.lit("that"), F.lit("with"))
    return t.select(
        "id", F.arrays_overlap("tags", F.array(*map(F.lit, ["that", "with", "dans", "sich"]))).alias("overlaps"),
        F.array_contains("tags", "with").alias("has_with"), F.size(F.filter("tags", lambda w: ~F.array_contains(stop, w))).alias("rest"),
    )


@query("p10_p11_list_spec", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '2-HIGH'")
def list_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = paging.ListSpec(id="o_orderkey", order="o_totalprice", choices={"o_orderstatus": ("O", "F", "P"), "o_orderpriority": ("1-URGENT", "2-HIGH")})
    return table(spark, sf_dir, "orders").filter(spec.filters({"o_orderstatus": "F", "o_orderpriority": "2-HIGH", "o_clerk": "x"})).select("o_orderkey")


@query("p13_p14_p23_p24_states", """WITH s AS (SELECT d.doc_id, CASE WHEN d.doc_id % 3 = 0 THEN TIMESTAMP '2024-01-01' END AS enriched_at, l.quality, l.toxic, CASE WHEN d.doc_id % 4 = 0 THEN d.doc_id % 8 END AS failures, d.n_chars
  FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT doc_id, CASE WHEN enriched_at IS NOT NULL THEN 'enriched' WHEN failures > 0 THEN 'failed' ELSE 'pending' END AS state,
  concat_ws('; ', CASE WHEN n_chars < 50 THEN 'Summary too short' END, CASE WHEN quality < 1 THEN 'Low confidence score' END, CASE WHEN failures > 0 THEN 'Enrichment failed' END) AS review_reason,
  COALESCE(toxic, 0) = 0 AND NOT COALESCE(n_chars < 50 OR quality < 1 OR failures > 0, FALSE) AS is_public FROM s""")
def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    failures = F.when(F.col("doc_id") % 4 == 0, F.col("doc_id") % 8)
    enriched = F.when(F.col("doc_id") % 3 == 0, F.lit("2024-01-01"))
    short, low, failed = F.col("n_chars") < 50, F.col("quality") < 1, failures > 0
    return s.select(
        "doc_id", F.when(enriched.isNotNull(), "enriched").when(failed, "failed").otherwise("pending").alias("state"),
        F.concat_ws("; ", F.when(short, "Summary too short"), F.when(low, "Low confidence score"), F.when(failed, "Enrichment failed")).alias("review_reason"),
        ((F.coalesce("toxic", F.lit(0)) == 0) & ~F.coalesce(short | low | failed, F.lit(False))).alias("is_public"),
    )


QUEUE_TIME = "2024-01-15 12:00:00"
RUNNABLE_SQL = f"(processed_at IS NULL AND (status = 'pending' OR COALESCE(status = 'processing' AND started_at < TIMESTAMP '{QUEUE_TIME}' - INTERVAL 5 MINUTE, FALSE)) AND (run_at IS NULL OR run_at <= TIMESTAMP '{QUEUE_TIME}') AND attempts < max_attempts)"


@query("p15_p17_blockers", f"""WITH {JOBS_SQL} SELECT id, CASE WHEN processed_at IS NOT NULL THEN 'already_processed' WHEN status = 'processing' AND started_at >= TIMESTAMP '{QUEUE_TIME}' - INTERVAL 5 MINUTE THEN 'processing_fresh'
  WHEN run_at > TIMESTAMP '{QUEUE_TIME}' THEN 'future_run_at' WHEN attempts >= max_attempts THEN 'max_attempts_reached' ELSE 'runnable' END AS blocker, {RUNNABLE_SQL} AS runnable FROM jobs""")
def blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.jobs(spark, sf_dir).select("id", queue.blocker(QUEUE_TIME).alias("blocker"), queue.runnable(QUEUE_TIME).alias("runnable"))


@query("t12_z03_claim", f"""WITH {JOBS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY job_type ORDER BY run_at NULLS FIRST, id) AS n FROM jobs WHERE {RUNNABLE_SQL})
SELECT id, job_type, CAST(attempts + CASE WHEN status = 'pending' THEN 1 ELSE 0 END AS INTEGER) AS attempts FROM r WHERE n <= 3""")
def claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.claim(frames.jobs(spark, sf_dir), QUEUE_TIME, per_type=3).select("id", "job_type", "attempts")


@query("c30_c31_d07_finish", f"""WITH {JOBS_SQL}, x AS (SELECT id, job_type, attempts, CASE WHEN status = 'processing' AND started_at < TIMESTAMP '{QUEUE_TIME}' - INTERVAL 30 MINUTE THEN 'pending' ELSE status END AS status0, attempts > 2 AS failed, status = 'processing' AND job_type <> 'view' AS reported FROM jobs)
SELECT id, CASE WHEN reported AND NOT failed THEN 'done' WHEN reported AND attempts >= 4 THEN 'failed' WHEN reported THEN 'pending' ELSE status0 END AS status,
  CASE WHEN reported AND failed AND attempts < 4 THEN CAST(power(2, least(attempts, 10)) AS INTEGER) ELSE 0 END AS wait_minutes FROM x""")
def finish(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = queue.reset_stuck(frames.jobs(spark, sf_dir), QUEUE_TIME)
    done = frames.jobs(spark, sf_dir).filter("status = 'processing' and job_type <> 'view'").select("id", (F.col("attempts") <= 2).alias("ok"))
    after = queue.finish(jobs.withColumn("run_at", F.lit(None).cast("timestamp_ntz")), done, QUEUE_TIME)
    minutes = (F.unix_micros(F.col("run_at").cast("timestamp")) - F.unix_micros(F.lit(QUEUE_TIME).cast("timestamp"))) / 60_000_000
    return after.select("id", "status", F.coalesce(minutes, F.lit(0)).cast("int").alias("wait_minutes"))


@query("s17_w01_enqueue", f"""WITH {JOBS_SQL}, incoming AS (SELECT *, row_number() OVER (PARTITION BY job_type, payload_hash ORDER BY id) AS n FROM jobs WHERE status = 'pending')
SELECT id, job_type, payload_hash FROM incoming i WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM jobs j WHERE j.status <> 'pending' AND j.processed_at IS NULL AND j.job_type = i.job_type AND j.payload_hash = i.payload_hash)""")
def enqueue(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = frames.jobs(spark, sf_dir)
    return queue.enqueue(jobs.filter("status <> 'pending'"), jobs.filter("status = 'pending'")).select("id", "job_type", "payload_hash")


@query("j01_j06_j08_story_articles", f"""WITH {ARTICLES_SQL}, {LINKS_SQL}, agg AS (SELECT l.story_id, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT a.source_name) AS BIGINT) AS sources, max(a.published_at) AS latest FROM links l JOIN articles a ON a.id = l.article_id GROUP BY 1)
SELECT l.article_id, l.story_id, a.source_name, COALESCE(g.n, 0) AS n, g.sources, strftime(g.latest, '%Y-%m-%d %H:%M:%S') AS latest FROM links l JOIN articles a ON a.id = l.article_id LEFT JOIN agg g ON g.story_id = l.story_id""")
def story_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = frames.links(spark, sf_dir).join(frames.articles(spark, sf_dir), F.col("article_id") == F.col("id"))
    agg = joined.groupBy("story_id").agg(F.count("*").alias("n"), F.countDistinct("source_name").alias("sources"), F.max("published_at").alias("latest"))
    return joined.join(agg, "story_id", "left").select("article_id", "story_id", "source_name", F.coalesce("n", F.lit(0)).alias("n"), "sources", F.date_format("latest", "yyyy-MM-dd HH:mm:ss").alias("latest"))


@query("j02_j03_u04_unclustered", f"WITH {LINKS_SQL} SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.article_id = d.doc_id)")
def unclustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(frames.links(spark, sf_dir), F.col("doc_id") == F.col("article_id"), "left_anti").select("doc_id")


@query("j04_c28_with_articles", f"WITH {ARTICLES_SQL}, {LINKS_SQL}, {STORIES_SQL} SELECT id FROM stories s WHERE EXISTS (SELECT 1 FROM links l WHERE l.story_id = s.id AND l.is_primary) AND s.last_article_at < TIMESTAMP '{AS_OF}' - INTERVAL 12 HOUR ORDER BY s.last_article_at, id LIMIT 50")
def with_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = frames.stories(spark, sf_dir).join(frames.links(spark, sf_dir).filter("is_primary"), F.col("id") == F.col("story_id"), "left_semi")
    due = F.col("last_article_at") < F.lit(AS_OF).cast("timestamp_ntz") - F.expr("INTERVAL 12 HOURS")
    return s.filter(due).orderBy(F.col("last_article_at").asc_nulls_first(), "id").limit(50).select("id")


@query("j05_j09_explode", f"WITH {ARTICLES_SQL}, t AS (SELECT id, source_name, unnest({TAGS}) AS tag FROM articles) SELECT source_name, tag, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT id) AS BIGINT) AS articles FROM t GROUP BY 1, 2 HAVING count(*) >= 3")
def explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = frames.articles(spark, sf_dir).select("id", "source_name", F.explode(F.array_distinct(T.tokens(F.col("title"), 4))).alias("tag"))
    return t.groupBy("source_name", "tag").agg(F.count("*").alias("n"), F.countDistinct("id").alias("articles")).filter("n >= 3")


@query("j07_a02_feed_health", f"""SELECT s.s_suppkey, s.s_name, CAST(count(e.event_id) AS BIGINT) AS events, CAST(count(*) FILTER (WHERE e.event_type = 'error') AS BIGINT) AS errors,
  CASE WHEN count(e.event_id) = 0 THEN 'silent' WHEN count(*) FILTER (WHERE e.event_type = 'error') * 2 > count(e.event_id) THEN 'failing' ELSE 'healthy' END AS health, strftime(max(e.ts), '%Y-%m-%d %H:%M:%S') AS last_seen
FROM supplier s LEFT JOIN events e ON e.user_id = s.s_suppkey AND e.ts >= TIMESTAMP '{AS_OF}' - INTERVAL 48 HOUR GROUP BY 1, 2""")
def feed_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every feed with what it did in the last two days; feeds without events stay."""
    recent = table(spark, sf_dir, "events").filter(F.col("ts") >= F.lit(AS_OF).cast("timestamp") - F.expr("INTERVAL 48 HOURS"))
    joined = table(spark, sf_dir, "supplier").join(recent, F.col("user_id") == F.col("s_suppkey"), "left")
    errors = F.count_if(F.col("event_type") == "error")
    agg = joined.groupBy("s_suppkey", "s_name").agg(F.count("event_id").alias("events"), errors.alias("errors"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_seen"))
    return agg.withColumn("health", F.when(F.col("events") == 0, "silent").when(F.col("errors") * 2 > F.col("events"), "failing").otherwise("healthy"))


@query("j12_j13_interval", f"""WITH {ARTICLES_SQL}, {LINKS_SQL}, {STORIES_SQL} SELECT a.id AS article_id, s.id AS story_id FROM articles a JOIN stories s ON s.last_article_at BETWEEN a.published_at - INTERVAL 72 HOUR AND a.published_at + INTERVAL 1 HOUR""")
def interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories whose last article is at most 72 hours before the article or one after; joined on days, then exactly."""
    a = frames.articles(spark, sf_dir).select(F.col("id").alias("article_id"), "published_at")
    low, high = F.col("published_at") - F.expr("INTERVAL 72 HOURS"), F.col("published_at") + F.expr("INTERVAL 1 HOUR")
    days = a.withColumn("day", F.explode(F.sequence(F.to_date(low), F.to_date(high))))
    s = frames.stories(spark, sf_dir).select(F.col("id").alias("story_id"), "last_article_at", F.to_date("last_article_at").alias("day"))
    return days.join(s, "day").filter(F.col("last_article_at").between(low, high)).select("article_id", "story_id")


@query("j17_tombstones", "WITH RECURSIVE p AS (SELECT doc_id AS id, CASE WHEN doc_id % 10 < 7 THEN NULL WHEN doc_id % 50 = 9 THEN doc_id + 10 - (doc_id // 10 % 2) * 20 ELSE doc_id - doc_id % 10 + (doc_id % 10 - 7) END AS into_id FROM documents), w AS (SELECT id, id AS at, 0 AS n FROM p UNION ALL SELECT w.id, p.into_id, w.n + 1 FROM w JOIN p ON p.id = w.at WHERE p.into_id IS NOT NULL AND w.n < 20) SELECT w.id, w.at AS survivor FROM w LEFT JOIN p ON p.id = w.at WHERE p.id IS NOT NULL AND p.into_id IS NULL UNION ALL SELECT id, NULL FROM p WHERE id NOT IN (SELECT w.id FROM w JOIN p ON p.id = w.at WHERE p.into_id IS NULL)")
def tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.operators.maintenance import survivors

    i = F.col("doc_id")
    into = F.when(i % 10 < 7, F.lit(None)).when(i % 50 == 9, i + 10 - (F.floor(i / 10) % 2) * 20).otherwise(i - i % 10 + (i % 10 - 7))
    return survivors(table(spark, sf_dir, "documents").select(i.alias("id"), into.cast("long").alias("into_id")))


@query("j19_v13_v14_aliases", """WITH t AS (SELECT doc_id, upper(trim(unnest(string_split(substr(replace(text, chr(10), ' '), 1, 80), ' ')))) AS word FROM documents), m AS (SELECT * FROM (VALUES ('THE', 'EN-THE'), ('DER', 'DE-DER'), ('LA', 'ES-LA'), ('LE', 'FR-LE'), ('OF', NULL)) v(alias, id))
SELECT t.doc_id, string_agg(DISTINCT m.id, ',' ORDER BY m.id) AS entities FROM t JOIN m ON m.alias = t.word WHERE m.id IS NOT NULL AND regexp_matches(m.id, '^[A-Z]{2}-[A-Z-]+$') GROUP BY 1""")
def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.operators.maintenance import normalise_entities

    words = table(spark, sf_dir, "documents").select("doc_id", F.split(F.substring(F.replace("text", F.lit("\n"), F.lit(" ")), 1, 80), " ").alias("raw"))
    names = spark.createDataFrame([("THE", "EN-THE"), ("der", "DE-DER"), ("La", "ES-LA"), ("le", "FR-LE"), ("OF", None)], "alias string, entity string")
    found = normalise_entities(words, "doc_id", "raw", names, r"^[A-Z]{2}-[A-Z-]+$")
    return found.select("doc_id", F.array_join("entities", ",").alias("entities"))


@query("j19_v14_all_aliases", """WITH t AS (SELECT DISTINCT doc_id, upper(trim(unnest(string_split(replace(text, chr(10), ' '), ' ')))) AS word FROM documents), m AS (SELECT * FROM (VALUES ('THE', 'EN-THE'), ('DER', 'DE-DER'), ('LA', 'ES-LA'), ('LE', 'FR-LE'), ('OF', NULL)) v(alias, id))
SELECT t.doc_id, string_agg(DISTINCT m.id, ',' ORDER BY m.id) AS entities FROM t JOIN m ON m.alias = t.word WHERE m.id IS NOT NULL AND regexp_matches(m.id, '^[A-Z]{2}-[A-Z-]+$') GROUP BY 1""")
def all_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entities of whole texts; a text's distinct words are looked up."""
    from weftline.operators.maintenance import normalise_entities

    words = table(spark, sf_dir, "documents").select("doc_id", F.array_distinct(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).alias("raw"))
    names = spark.createDataFrame([("THE", "EN-THE"), ("der", "DE-DER"), ("La", "ES-LA"), ("le", "FR-LE"), ("OF", None)], "alias string, entity string")
    found = normalise_entities(words, "doc_id", "raw", names, r"^[A-Z]{2}-[A-Z-]+$")
    return found.select("doc_id", F.array_join("entities", ",").alias("entities"))


@query("j20_w03_latest", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("e"))
    return best.select("user_id", "e.event_id", "e.event_type")


@query("j21_c12_same_title", f"""WITH {ARTICLES_SQL}, t AS (SELECT id, trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]', ' ', 'g'), '\\s+', ' ', 'g')) AS norm, published_at FROM articles)
SELECT id, first_value(id) OVER (PARTITION BY norm ORDER BY published_at, id) AS leader FROM t WHERE length(norm) >= 20""")
def same_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = frames.articles(spark, sf_dir).select("id", T.normalise_title(F.col("title")).alias("norm"), "published_at").filter(F.length("norm") >= 20)
    leaders = t.groupBy("norm").agg(F.min(F.struct("published_at", "id")).alias("first"))
    return t.join(leaders, "norm").select("id", F.col("first.id").alias("leader"))


BLOCKS_SQL = f"""{ARTICLES_SQL}, e AS (SELECT id, source_name, lang, published_at, list_sort({TAGS})[1] AS tag FROM articles),
  src AS (SELECT a.id AS a, b.id AS b, 1 AS block, row_number() OVER (PARTITION BY a.id ORDER BY b.published_at DESC, b.id) AS n FROM e a JOIN e b ON a.source_name = b.source_name AND a.published_at = b.published_at AND a.id <> b.id),
  tag AS (SELECT a.id AS a, b.id AS b, 2 AS block, row_number() OVER (PARTITION BY a.id ORDER BY b.id DESC) AS n FROM e a JOIN e b ON a.tag = b.tag AND a.lang = b.lang AND a.id <> b.id)"""


@query("j18_v03_w04_u01_u06_blocks", f"WITH {BLOCKS_SQL}, u AS (SELECT a, b, block, n FROM src WHERE n <= 20 UNION ALL SELECT a, b, block, n FROM tag WHERE n <= 20), d AS (SELECT a, b, min(block * 1000 + n) AS place FROM u GROUP BY 1, 2) SELECT a, b, CAST(place // 1000 AS INTEGER) AS block FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY place, b) AS k FROM d) WHERE k <= 25")
def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.operators.candidates import Block, candidates

    a = frames.articles(spark, sf_dir).select("id", "source_name", "lang", "published_at", F.get(F.array_sort(F.array_distinct(T.tokens(F.col("title"), 4))), F.lit(0)).alias("tag"))
    chosen = [
        Block(("source_name", "published_at"), (F.col("published_at").desc(), F.col("b")), 20),
        Block(("tag", "lang"), (F.col("b").desc(),), 20),
    ]
    return candidates(a, a, "id", chosen, cap=25).select("a", "b", "block")


@query("u02_u03_u05_sets", f"""WITH {ARTICLES_SQL}, t AS (SELECT id, {TAGS} AS tags, list_distinct(string_split(lower(source_name || ' ' || lang), ' ')) AS names FROM articles)
SELECT id, array_to_string(list_sort(list_distinct(list_concat(tags, names))), ',') AS both_sets, round(CASE WHEN len(list_distinct(list_concat(tags, ['that', 'with']))) > 0 THEN len(list_intersect(tags, ['that', 'with'])) / len(list_distinct(list_concat(tags, ['that', 'with']))) ELSE 0 END, 6) AS jaccard FROM t""")
def sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = frames.articles(spark, sf_dir).select("id", F.array_distinct(T.tokens(F.col("title"), 4)).alias("tags"), F.array(F.lower("source_name"), F.col("lang")).alias("names"))
    return t.select("id", F.array_join(F.array_sort(F.array_union("tags", "names")), ",").alias("both_sets"), F.round(T.jaccard(F.col("tags"), F.array(F.lit("that"), F.lit("with"))), 6).alias("jaccard"))


@query("w02_a42_spend", """WITH d AS (SELECT CAST(ts AS DATE) AS day, sum(value) AS spent, CAST(count(*) AS BIGINT) AS calls FROM events GROUP BY 1)
SELECT strftime(day, '%Y-%m-%d') AS day, round(spent, 4) AS spent, calls, round(spent - lag(spent) OVER (ORDER BY day), 4) AS change, CASE WHEN spent > 1.5 * avg(spent) OVER () THEN 'high' ELSE 'normal' END AS band FROM d""")
def spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.sum("value").alias("spent"), F.count("*").alias("calls"))
    by_day, whole = Window.orderBy("day"), Window.partitionBy()  # one row per day
    return d.select(
        F.date_format("day", "yyyy-MM-dd").alias("day"), F.round("spent", 4).alias("spent"), "calls", F.round(F.col("spent") - F.lag("spent").over(by_day), 4).alias("change"),
        F.when(F.col("spent") > 1.5 * F.avg("spent").over(whole), "high").otherwise("normal").alias("band"),
    )


@query("w06_w07_top_articles", f"""WITH {ARTICLES_SQL}, {LINKS_SQL}, r AS (SELECT l.*, row_number() OVER (PARTITION BY story_id ORDER BY is_primary DESC, similarity DESC, published_at DESC, article_id) AS n, first_value(article_id) OVER (PARTITION BY story_id ORDER BY published_at, article_id) AS earliest FROM links l JOIN articles a ON a.id = l.article_id)
SELECT story_id, article_id, CAST(n AS INTEGER) AS n, earliest FROM r WHERE n <= 6""")
def top_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = frames.links(spark, sf_dir).join(frames.articles(spark, sf_dir), F.col("article_id") == F.col("id"))
    order = Window.partitionBy("story_id").orderBy(F.col("is_primary").desc(), F.col("similarity").desc(), F.col("published_at").desc(), "article_id")
    earliest = joined.groupBy("story_id").agg(F.min(F.struct("published_at", "article_id")).alias("e")).select("story_id", F.col("e.article_id").alias("earliest"))
    return joined.withColumn("n", F.row_number().over(order)).filter("n <= 6").join(earliest, "story_id").select("story_id", "article_id", "n", "earliest")


@query("w08_consecutive", "SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS DISTINCT FROM event_type")
def consecutive(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").withColumn("before", before).filter(~F.col("before").eqNullSafe(F.col("event_type"))).select("user_id", "event_id", "event_type")


@query("w09_budget", "SELECT event_id FROM (SELECT event_id, sum(0.01) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS spent FROM events) WHERE spent <= 1.0")
def budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of equal cost that a day's budget admits, in order of time."""
    calls = F.row_number().over(Window.partitionBy(F.to_date("ts")).orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").withColumn("n", calls).filter(F.col("n") * F.lit("0.01").cast("decimal(10,2)") <= 1).select("event_id")


@query("w10_rate_limit", "SELECT event_id, m <= 1 AND d <= 3 AS allowed FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, date_trunc('minute', ts) ORDER BY ts, event_id) AS m, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS d FROM events)")
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    minute = Window.partitionBy("user_id", F.date_trunc("minute", "ts")).orderBy("ts", "event_id")
    day = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", ((F.row_number().over(minute) <= 1) & (F.row_number().over(day) <= 3)).alias("allowed"))


@query("t01_t06_keyset", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderdate < TIMESTAMP '1998-06-01' OR (o_orderdate = TIMESTAMP '1998-06-01' AND o_orderkey < 500) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 31")
def keyset(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = paging.ListSpec(id="o_orderkey", order="o_orderdate")
    o = table(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz").cast("string"))
    cursor = paging.decode_cursor(paging.encode_cursor("1998-06-01 00:00:00", 500))
    return paging.keyset_page(o, spec, cursor).select("o_orderkey", F.substring("o_orderdate", 1, 10).alias("day"))


@query("t07_t08_null_tail", "WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price FROM orders) SELECT * FROM (SELECT o_orderkey, price, 'first' AS page FROM o WHERE price < 1500 OR price IS NULL ORDER BY price DESC NULLS LAST, o_orderkey DESC LIMIT 100) UNION ALL SELECT * FROM (SELECT o_orderkey, price, 'tail' AS page FROM o WHERE price IS NULL AND o_orderkey < 700 ORDER BY o_orderkey DESC LIMIT 100)")
def null_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two pages of a list by a nullable price: one that crosses into the rows without a price, one inside them."""
    spec = paging.ListSpec(id="o_orderkey", order="price", limit=100)
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("price"))
    first = paging.keyset_page(o, spec, (1500.0, 0), probe=False).withColumn("page", F.lit("first"))
    tail = paging.keyset_page(o, spec, (None, 700), probe=False).withColumn("page", F.lit("tail"))
    return first.unionByName(tail)


@query("t02_t10_offset_pages", "SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey DESC) - 1) // 50 + 1 AS BIGINT) AS page, CAST(ceil(count(*) OVER () / 50.0) AS BIGINT) AS pages, CAST(count(*) OVER () AS BIGINT) AS total FROM orders")
def offset_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = paging.ListSpec(id="o_orderkey", order="o_totalprice")
    return paging.numbered_pages(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), spec, 50).select("o_orderkey", "page", "pages", "total")


@query("t04_t13_t15_top", "SELECT o_orderkey, CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END AS INTEGER) AS lane FROM orders ORDER BY 2, o_totalprice DESC, o_orderkey LIMIT 60")
def top(spark: SparkSession, sf_dir: str) -> DataFrame:
    lane = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    return table(spark, sf_dir, "orders").withColumn("lane", lane).orderBy("lane", F.col("o_totalprice").desc(), "o_orderkey").limit(max(1, 60)).select("o_orderkey", "lane")


@query("z10_z11_detail", f"WITH {ARTICLES_SQL}, {LINKS_SQL} SELECT l.story_id, l.article_id, a.title FROM links l JOIN articles a ON a.id = l.article_id WHERE l.story_id = 3")
def detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One story with its articles."""
    return frames.links(spark, sf_dir).filter("story_id = 3").join(frames.articles(spark, sf_dir), F.col("article_id") == F.col("id")).select("story_id", "article_id", "title")
