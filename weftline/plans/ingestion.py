"""Upserts, idempotent inserts, log sources and remaining updates as queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import relevance, upsert
from weftline.plans.lineage import checkpoint_dir
from weftline.plans.registry import query
from weftline.sources import feeds, frames
from weftline.sources.frames import ARTICLES_SQL, table


@query("s15_s16_upsert", f"""WITH {ARTICLES_SQL}, k AS (SELECT sha256(title) AS url_hash, strftime(published_at, '%Y-%m-%d') AS day, id, left(content, 500) AS excerpt, source_name, published_at FROM articles),
  old AS (SELECT url_hash, day, arg_max(id, id) AS id, arg_max(source_name, id) AS source_name, arg_max(md5(excerpt), id) AS excerpt FROM k WHERE source_name < 'src2' GROUP BY 1, 2), new AS (SELECT url_hash, day, max(id) AS id, arg_max(source_name, id) AS source_name, arg_max(md5(excerpt), id) AS excerpt FROM k WHERE source_name >= 'src10' GROUP BY 1, 2)
SELECT COALESCE(o.url_hash, n.url_hash) AS url_hash, COALESCE(o.day, n.day) AS day, COALESCE(o.id, n.id) AS id, COALESCE(n.source_name, o.source_name) AS source_name, COALESCE(n.excerpt, o.excerpt) AS excerpt, o.url_hash IS NULL AS is_new, o.url_hash IS NOT NULL AND n.url_hash IS NOT NULL AS is_updated FROM old o FULL JOIN new n ON o.url_hash = n.url_hash AND o.day = n.day""")
def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of some sources stored, those of others coming in; the key is the hash of the title and the day."""
    a = frames.articles(spark, sf_dir).select(F.sha2("title", 256).alias("url_hash"), F.date_format("published_at", "yyyy-MM-dd").alias("day"), "id", "source_name", F.md5(F.substring("content", 1, 500)).alias("excerpt"))
    first = a.filter("source_name < 'src2'")
    stored = upsert.upsert(first.limit(0), first, ["url_hash", "day"], order="id").drop("is_new", "is_updated")
    return upsert.upsert(stored, a.filter("source_name >= 'src10'"), ["url_hash", "day"], order="id", keep=("id",))


@query("s18_s19_changed", "WITH n AS (SELECT doc_id, CASE WHEN lang = 'de' THEN text || '!' ELSE text END AS text FROM documents) SELECT n.doc_id, sha256(n.text) AS content_hash FROM n LEFT JOIN (SELECT doc_id, text FROM documents WHERE lang <> 'fr') o USING (doc_id) WHERE o.doc_id IS NULL OR sha256(n.text) <> sha256(o.text)")
def changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    new = d.withColumn("text", F.when(F.col("lang") == "de", F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return upsert.changed(d.filter("lang <> 'fr'"), new, "doc_id", "text").select("doc_id", "content_hash")


@query("s20_z02_counters", "SELECT md5(event_type || user_id) AS term, CAST(count(*) AS BIGINT) AS n, strftime(min(ts), '%Y-%m-%d %H:%M') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M') AS last_seen FROM events GROUP BY 1")
def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of the first half of the month, after the sightings of the second."""
    e = table(spark, sf_dir, "events").select(F.md5(F.concat("event_type", F.col("user_id").cast("string"))).alias("term"), "ts")
    early = F.col("ts") < F.lit("2024-01-16").cast("timestamp")
    empty = e.limit(0).groupBy("term").agg(F.count("*").alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    stored = upsert.add_counts(empty, e.filter(early), "term", "ts")
    after = upsert.add_counts(stored, e.filter(~early), "term", "ts")
    return after.select("term", "n", *(F.date_format(c, "yyyy-MM-dd HH:mm").alias(c) for c in ("first_seen", "last_seen")))


@query("s24_s26_log_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def log_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records from log lines that carry them behind a marker; lines without a record fall out."""
    e = table(spark, sf_dir, "events")
    body = F.concat(F.lit('2024 INFO [SHADOW] {"event_id": '), F.col("event_id").cast("string"), F.lit(", "), F.expr("substring(props, 2)"), F.lit(" trailing"))
    lines = e.select(body.alias("value")).union(e.select(F.lit("2024 INFO nothing").alias("value"))).union(e.select(F.lit("x [SHADOW] {broken").alias("value")))
    return feeds.json_records(lines, "[SHADOW] ", "event_id long, k long")


@query("s25_scraper_log", "SELECT CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS kind, event_type AS source, CAST(count(*) AS BIGINT) AS n, CAST(sum(user_id) AS BIGINT) AS chars FROM events GROUP BY 1, 2")
def scraper_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    line = F.concat(F.when(F.col("event_type") == "error", "scrape FAILED source=").otherwise("scrape SUCCESS source="), F.col("event_type"), F.lit(" chars="), F.col("user_id").cast("string"))
    return feeds.scraper_events(e.select(line.alias("value"))).groupBy("kind", "source").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))


@query("p22_search_terms", "WITH t AS (SELECT doc_id, lower(trim(regexp_replace(substr(text, 1, 60), '\\s+', ' ', 'g'))) AS term FROM documents) SELECT doc_id, CASE WHEN NOT (length(term) < 2 OR length(term) > 80 OR regexp_matches(term, '@|https?:|[0-9]{7,}|[<>{}]')) THEN term END AS term FROM t")
def search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", relevance.search_term(F.substring("text", 1, 60)).alias("term"))


@query("p22_whole_terms", "WITH t AS (SELECT doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS term FROM documents) SELECT doc_id, CASE WHEN NOT (length(term) < 2 OR length(term) > 80 OR regexp_matches(term, '@|https?:|[0-9]{7,}|[<>{}]')) THEN term END AS term FROM t")
def whole_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as search terms: what is too long or private anywhere is refused."""
    return table(spark, sf_dir, "documents").select("doc_id", relevance.search_term(F.col("text")).alias("term"))


@query("p25_p26_violations", "SELECT doc_id, concat_ws(',', CASE WHEN (quality IS NULL) <> (toxic IS NULL) THEN 'group' END, CASE WHEN quality NOT BETWEEN 0 AND 1 THEN 'range' END, CASE WHEN quality = 1 AND toxic = 1 THEN 'contradiction' END) AS violations FROM labels WHERE (quality IS NULL) <> (toxic IS NULL) OR quality NOT BETWEEN 0 AND 1 OR (quality = 1 AND toxic = 1)")
def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that break a rule of the table, with the rules they break."""
    q, t = F.col("quality"), F.col("toxic")
    rules = {"group": q.isNull() != t.isNull(), "range": ~q.between(0, 1), "contradiction": (q == 1) & (t == 1)}
    broken = F.concat_ws(",", *(F.when(rule, name) for name, rule in rules.items()))
    return table(spark, sf_dir, "labels").select("doc_id", broken.alias("violations")).filter("violations <> ''")


@query("z01_c29_guarded", "SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'conflict' ELSE 'updated' END AS status FROM orders")
def guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates that hold only while the row is as it was read."""
    o = table(spark, sf_dir, "orders")
    seen = F.when(F.col("o_orderpriority") == "5-LOW", F.col("o_orderdate") - F.expr("INTERVAL 1 DAY")).otherwise(F.col("o_orderdate"))
    return upsert.guarded_update(o, o.select("o_orderkey", seen.alias("o_orderdate")), "o_orderkey", "o_orderdate").select("o_orderkey", "status")


@query("f20_f21_z08_conversations", """WITH c AS (SELECT conv_id, turn, role, text, CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END AS rank FROM conversations)
SELECT conv_id, CAST(count(*) AS BIGINT) AS turns, md5(string_agg('[' || role || '] ' || text, chr(10) ORDER BY rank, turn)) AS document, max(CASE WHEN contains(lower(text), 'affirmed') THEN 'affirmed' WHEN contains(lower(text), 'reversed') THEN 'reversed' ELSE 'none' END) AS evidence FROM c GROUP BY 1""")
def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a document in the order of their kind, joined under headers, with the first evidence found."""
    rank = F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).otherwise(2)
    low = F.lower("text")
    evidence = F.when(low.contains("affirmed"), "affirmed").when(low.contains("reversed"), "reversed").otherwise("none")
    parts = F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "turn", F.concat(F.lit("["), F.col("role"), F.lit("] "), F.col("text")).alias("part"))))
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.md5(F.array_join(F.transform(parts, lambda x: x["part"]), "\n")).alias("document"), F.max(evidence).alias("evidence"))
    return c


@query("s01_s04_feed_items", f"WITH {ARTICLES_SQL} SELECT trim(title) AS title, 'http://' || source_domain || '/' || id AS link, 'g' || id AS guid, source_name AS author FROM articles WHERE trim(title) <> ''")
def feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles written as feed items and read back as a feed reader does."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/feed-{uuid.uuid4().hex}"
    a = frames.articles(spark, sf_dir).filter(F.trim("title") != "")
    guid = F.struct(F.concat(F.lit("g"), F.col("id").cast("string")).alias("_VALUE"), F.lit("false").alias("_isPermaLink"))
    a.select("title", F.concat(F.lit("http://"), "source_domain", F.lit("/"), F.col("id").cast("string")).alias("link"), guid.alias("guid"), F.col("source_name").alias("creator")).write.format("xml").option("rowTag", "item").option("rootTag", "channel").save(path)
    return feeds.read_items(spark, path).select("title", "link", "guid", "author")


@query("s22_s23_csv", "SELECT doc_id, md5(text) AS text_md5, lang FROM documents")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{checkpoint_dir(spark).rstrip('/')}/csv-{uuid.uuid4().hex}"
    feeds.write_csv(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), path)
    return feeds.read_csv(spark, path, "doc_id long, text string, lang string").select("doc_id", F.md5("text").alias("text_md5"), "lang")


@query("c29_undo", "SELECT o_orderkey AS id, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 7) THEN 'was' ELSE o_orderpriority END AS priority, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 7) THEN 'priority' END AS undone FROM orders")
def undo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders after their last change is undone; changes are made of their lines."""
    from weftline.operators.admin import undo_last

    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority"))
    history = table(spark, sf_dir, "lineitem").filter("l_linenumber = 7").select(F.col("l_orderkey").alias("id"), F.lit("priority").alias("field"), F.lit("was").alias("old_value"), F.col("l_shipdate").alias("changed_at"), F.col("l_linenumber").alias("change"))
    return undo_last(rows, history, ["priority"])


@query("z12_z13_corrections", "SELECT c_custkey, c_acctbal >= 0 AS active FROM customer")
def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.operators.admin import withdraw

    c = table(spark, sf_dir, "customer").select("c_custkey", F.md5(F.col("c_custkey").cast("string")).alias("token"), F.lit(True).alias("active"), "c_acctbal")
    shown = c.filter("c_acctbal < 0").select("token")
    return withdraw(c, shown.union(shown)).select("c_custkey", "active")


@query("d14_display_rows", """SELECT 'order' AS kind, CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS title, CAST(CASE WHEN o_orderstatus = 'F' THEN 4 ELSE 3 END AS INTEGER) AS alarm FROM orders
  UNION ALL SELECT 'part', CAST(p_partkey AS VARCHAR), p_name, CAST(CASE WHEN p_size > 0 THEN p_size % 6 ELSE 2 END AS INTEGER) FROM part UNION ALL SELECT 'page', CAST(page_id AS VARCHAR), url, 2 FROM pages""")
def display_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of different tables in one display schema."""
    as_text = lambda c: F.col(c).cast("string").alias("id")
    orders = table(spark, sf_dir, "orders").select(F.lit("order").alias("kind"), as_text("o_orderkey"), F.col("o_orderpriority").alias("title"), F.when(F.col("o_orderstatus") == "F", 4).otherwise(3).alias("alarm"))
    parts = table(spark, sf_dir, "part").select(F.lit("part").alias("kind"), as_text("p_partkey"), F.col("p_name").alias("title"), F.when(F.col("p_size") > 0, F.col("p_size") % 6).otherwise(2).cast("int").alias("alarm"))
    pages = table(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), as_text("page_id"), F.col("url").alias("title"), F.lit(2).alias("alarm"))
    return orders.unionByName(parts).unionByName(pages)


@query("f42_d02_v15_records", """SELECT event_id, sha256('{"event_id":' || event_id || CASE WHEN user_id < 100 THEN ',"user_id":' || user_id ELSE '' END || '}') AS payload_hash, CASE WHEN user_id < 50 THEN 'range' WHEN user_id < 100 THEN 'article' ELSE 'created' END AS anchor, CASE WHEN event_type = 'error' THEN 'B' WHEN event_type = 'click' THEN 'A,B' ELSE 'A' END AS entities FROM events""")
def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of records without their nulls, the first known time, and entities that are sure enough."""
    from weftline.functions.text import record_hash
    from weftline.operators.scoring import confident_entities, time_anchor

    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    entity = lambda name, sure: F.struct(F.lit(name).alias("id"), sure.cast("double").alias("confidence"))
    found = F.array(entity("A", F.when(kind == "error", 0.5).otherwise(0.7)), entity("B", F.when(kind == "error", None).when(kind == "click", 0.9).otherwise(0.1)), entity("A", F.lit(0.2)))
    anchor = time_anchor(("range", F.when(F.col("user_id") < 50, F.col("ts"))), ("article", F.when(F.col("user_id") < 100, F.col("ts"))), ("created", F.col("ts")))
    return e.select(
        "event_id", record_hash(F.struct("event_id", F.when(F.col("user_id") < 100, F.col("user_id")).alias("user_id"))).alias("payload_hash"), anchor["source"].alias("anchor"),
        F.array_join(F.transform(confident_entities(found), lambda x: x["id"]), ",").alias("entities"),
    )


@query("s10_s11_html_rows", """WITH r AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<p[^>]*>([^<]*)</p>', 1)) AS cell FROM pages) SELECT page_id, trim(cell) AS cell, substr(sha256(lower(trim(cell)) || '|' || page_id), 1, 16) AS source_key FROM r WHERE trim(cell) <> ''""")
def html_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of pages' elements, each with a key made of its text and page."""
    cells = F.explode(F.regexp_extract_all("html", F.lit("(?i)<p[^>]*>([^<]*)</p>"), F.lit(1)))
    r = table(spark, sf_dir, "pages").select("page_id", cells.alias("cell")).select("page_id", F.trim("cell").alias("cell")).filter("cell <> ''")
    return r.withColumn("source_key", F.substring(F.sha2(F.concat_ws("|", F.lower("cell"), F.col("page_id").cast("string")), 256), 1, 16))
