"""Scans, sinks, labels, cursors and audits as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import dates
from weftline.functions import vectors as V
from weftline.operators import paging, search
from weftline.operators.queue import timestamp
from weftline.operators.upsert import upsert
from weftline.plans.registry import query
from weftline.sources import frames, pages
from weftline.sources.frames import ARTICLES_SQL, AS_OF, JOBS_SQL, table

NOW = f"TIMESTAMP '{AS_OF}'"
_CLEMENCY_SQL = """SELECT page_id, '<div class="field_body"><h3>' || ['January 21, 2025 - 1 Pardon', 'May 8, 2024 - 16 Pardons and 6 Commutations', 'March 3, 2023 - 2 Pre-emptive Pardons', 'soon'][CAST(page_id % 4 + 1 AS INTEGER)] || '</h3><table><tr><td> <b>Name ' || page_id || '</b></td><td>D</td><td>S</td><td>O</td></tr><tr><td>short</td></tr></table><h3>June 1, 2022 - 1 Commutation (Amended)</h3><table><tr><td>Ann ' || (page_id % 3) || '</td><td>1</td><td>2</td><td>3</td></tr></table></div>' AS html FROM pages"""


@query("s10_clemency_rows", f"""WITH h AS ({_CLEMENCY_SQL}), p AS (SELECT page_id, unnest(regexp_split_to_array(html, '(?i)<h3[^>]*>')[2:]) AS part FROM h), d AS (SELECT page_id, part, regexp_extract(part, '(?is)^(.*?)</h3>', 1) AS head FROM p), k AS (SELECT *, CASE WHEN contains(lower(head), 'commutation') THEN 'commutation' WHEN regexp_matches(lower(head), 'pre-?emptive') THEN 'pre_emptive' ELSE 'pardon' END AS kind, strftime(try_strptime(trim(regexp_replace(head, '(?i)\\s*-\\s*\\d+\\s*(pardon|commutation)s?(\\s*\\(amended\\))?(\\s+and\\s+\\d+\\s*(pardon|commutation)s?)?', '')), '%B %d, %Y'), '%Y-%m-%d') AS granted FROM d),
  r AS (SELECT page_id, kind, granted, unnest(regexp_extract_all(part, '(?is)<tr[^>]*>(.*?)</tr>', 1)) AS row FROM k WHERE granted IS NOT NULL), c AS (SELECT *, list_transform(regexp_extract_all(row, '(?is)<td[^>]*>(.*?)</td>', 1), lambda x: trim(regexp_replace(x, '<[^>]*>', '', 'g'))) AS cells FROM r)
SELECT page_id, cells[1] AS name, kind AS clemency_type, granted, substr(sha256(lower(cells[1]) || '|' || granted), 1, 16) AS source_key FROM c WHERE len(cells) >= 4""")
def clemency_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of made-up clemency pages, one per page of the table."""
    heads = F.array(*map(F.lit, ("January 21, 2025 - 1 Pardon", "May 8, 2024 - 16 Pardons and 6 Commutations", "March 3, 2023 - 2 Pre-emptive Pardons", "soon")))
    k = F.col("page_id")
    html = F.concat(
        F.lit('<div class="field_body"><h3>'), F.element_at(heads, (k % 4 + 1).cast("int")), F.lit("</h3><table><tr><td> <b>Name "), k.cast("string"), F.lit("</b></td><td>D</td><td>S</td><td>O</td></tr><tr><td>short</td></tr></table><h3>June 1, 2022 - 1 Commutation (Amended)</h3><table><tr><td>Ann "),
        (k % 3).cast("string"), F.lit("</td><td>1</td><td>2</td><td>3</td></tr></table></div>"),
    )
    return pages.clemency_rows(table(spark, sf_dir, "pages").select("page_id", html.alias("html")))


@query("s11_headlines", """WITH h AS (SELECT page_id, '<h2 class=x> <a href="' || url || '"><b>A long enough headline</b>  number ' || (page_id % 9) || '</a></h2><h3><a href=''/s''>short</a></h3>' || html AS html FROM pages), a AS (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '(?is)<h[23][^>]*>\\s*(<a[^>]*href=.*?</a>)\\s*</h[23]>', 1))) AS a FROM h),
  t AS (SELECT page_id, trim(regexp_replace(regexp_replace(a, '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')) AS title, regexp_extract(a, '(?i)href=["'']([^"'']*)["'']', 1) AS url FROM a) SELECT DISTINCT page_id, title, url, sha256(url) AS url_hash FROM t WHERE length(title) >= 20 AND url <> ''""")
def headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked headings of all pages, each with one more put before it."""
    more = F.concat(F.lit('<h2 class=x> <a href="'), "url", F.lit('"><b>A long enough headline</b>  number '), (F.col("page_id") % 9).cast("string"), F.lit("</a></h2><h3><a href='/s'>short</a></h3>"), "html")
    return pages.headline_articles(table(spark, sf_dir, "pages").select("page_id", more.alias("html")))


@query("s13_s14_scans", "SELECT o_orderkey, o_orderstatus, CAST(o_orderkey // 200 AS BIGINT) AS call FROM orders WHERE o_orderkey IN (SELECT DISTINCT user_id * 3 FROM events)")
def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a list of ids by one join, and the call of 200 that a client would have made for them; a whole table is read in one scan."""
    ids = table(spark, sf_dir, "events").select((F.col("user_id") * 3).alias("o_orderkey")).distinct()
    return table(spark, sf_dir, "orders").join(ids, "o_orderkey", "left_semi").select("o_orderkey", "o_orderstatus", F.floor(F.col("o_orderkey") / 200).alias("call"))


@query("s16_preserving_upsert", """WITH old AS (SELECT page_id, 'h' || page_id AS headline, CASE WHEN page_id % 3 > 0 THEN TIMESTAMP '2024-01-01 00:00:00' END AS published_at FROM pages WHERE page_id % 2 = 0), new AS (SELECT page_id, CASE WHEN page_id % 5 > 0 THEN 'n' || page_id END AS headline, TIMESTAMP '2024-02-02 00:00:00' AS published_at FROM pages WHERE page_id % 4 < 2)
SELECT COALESCE(old.page_id, new.page_id) AS page_id, COALESCE(new.headline, old.headline) AS headline, strftime(COALESCE(old.published_at, new.published_at), '%Y-%m-%d') AS published, old.page_id IS NULL AS is_new, old.page_id IS NOT NULL AND new.page_id IS NOT NULL AS is_updated FROM old FULL JOIN new ON old.page_id = new.page_id""")
def preserving_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New headlines replace stored ones, but a stored time of publication stays; one that is missing is filled."""
    k, p = F.col("page_id"), table(spark, sf_dir, "pages")
    old = p.filter(k % 2 == 0).select("page_id", F.concat(F.lit("h"), k.cast("string")).alias("headline"), F.when(k % 3 > 0, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("published_at"))
    new = p.filter(k % 4 < 2).select("page_id", F.when(k % 5 > 0, F.concat(F.lit("n"), k.cast("string"))).alias("headline"), F.lit("2024-02-02 00:00:00").cast("timestamp_ntz").alias("published_at"))
    done = upsert(old, new, ["page_id"], "published_at", keep=("published_at",))
    return done.select("page_id", "headline", F.date_format("published_at", "yyyy-MM-dd").alias("published"), "is_new", "is_updated")


@query("w10_fixed_buckets", "SELECT event_id, m <= 5 AND d <= 20 AS allowed FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id % 5, date_trunc('minute', ts) ORDER BY ts, event_id) AS m, row_number() OVER (PARTITION BY user_id % 5, CAST(ts AS DATE) ORDER BY ts, event_id) AS d FROM events)")
def fixed_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five requests a minute and twenty a day of every caller; a caller's day is the most that a task orders."""
    caller = F.col("user_id") % 5
    minute, day = (Window.partitionBy(caller, F.date_trunc(unit, "ts")).orderBy("ts", "event_id") for unit in ("minute", "day"))
    return table(spark, sf_dir, "events").select("event_id", ((F.row_number().over(minute) <= 5) & (F.row_number().over(day) <= 20)).alias("allowed"))


@query("d03_relative_dates", f"""WITH a AS (SELECT doc_id, floor(epoch({NOW} - ({NOW} - to_hours(CAST(doc_id * 7 % 20000 AS INTEGER)))) / 86400 + 0.5) AS d FROM documents)
SELECT doc_id, CASE WHEN d = 0 THEN 'today' WHEN d = 1 THEN 'yesterday' WHEN d < 7 THEN CAST(d AS INTEGER) || 'd ago' WHEN d < 30 THEN CAST(floor(d / 7 + 0.5) AS INTEGER) || 'w ago' WHEN d < 365 THEN CAST(floor(d / 30 + 0.5) AS INTEGER) || 'mo ago' ELSE CAST(floor(d / 365 + 0.5) AS INTEGER) || 'y ago' END AS shown FROM a""")
def relative_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = timestamp(AS_OF) - F.make_dt_interval(hours=(F.col("doc_id") * 7 % 20000).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", dates.rel_date(timestamp(AS_OF), at).alias("shown"))


@query("d07_backoffs", f"WITH {JOBS_SQL} SELECT id, CAST(power(2, least(attempts + id % 9, 10)) AS INTEGER) AS minutes, strftime({NOW} + to_minutes(CAST(power(2, least(attempts + id % 9, 10)) AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS next_run FROM jobs")
def backoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waits of 2 to the power of the attempts, with those beyond ten waiting no longer."""
    minutes = dates.backoff_minutes((F.col("attempts") + F.col("id") % 9).cast("int"))
    next_run = timestamp(AS_OF) + F.make_dt_interval(mins=minutes)
    return frames.jobs(spark, sf_dir).select("id", minutes.alias("minutes"), F.date_format(next_run, "yyyy-MM-dd HH:mm:ss").alias("next_run"))


@query("t09_t11_cursors", """WITH c AS (SELECT event_id, CASE WHEN event_id % 4 > 0 THEN event_type || '::' || event_id WHEN event_id % 8 = 0 THEN 'broken' ELSE 'a::b' END AS cursor, event_id % 12 + 1 AS cur, 12 AS total FROM events), x AS (SELECT *, regexp_extract(cursor, '^(.+)::(-?[0-9]{1,18})$', 1) AS v, regexp_extract(cursor, '^(.+)::(-?[0-9]{1,18})$', 2) AS i, list_sort(list_distinct([1, total, greatest(cur - 1, 1), cur, least(cur + 1, total)])) AS p FROM c)
SELECT event_id, CASE WHEN i <> '' THEN v END AS value, CAST(nullif(i, '') AS BIGINT) AS id, array_to_string(list_transform(p, lambda n, k: CASE WHEN k > 1 AND n - p[k - 1] > 1 THEN '…,' || n ELSE CAST(n AS VARCHAR) END), ',') AS pages FROM x""")
def cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cursors of a value and an id, malformed ones standing for the first page, and the page numbers that a list shows."""
    k = F.col("event_id")
    cursor = F.when(k % 4 > 0, F.concat_ws("::", "event_type", k.cast("string"))).when(k % 8 == 0, "broken").otherwise("a::b")
    shown = F.array_join(paging.shown_pages(k % 12 + 1, F.lit(12).cast("long")), ",", "…")
    c = table(spark, sf_dir, "events").select("event_id", paging.parse_cursor(cursor).alias("c"), shown.alias("pages"))
    return c.select("event_id", "c.value", "c.id", "pages")


@query("z13_date_audit", f"""WITH e AS (SELECT doc_id AS id, {NOW} - to_hours(CAST(doc_id % 720 AS INTEGER)) AS claimed, {NOW} - to_hours(CAST(CASE WHEN doc_id % 3 = 0 THEN doc_id % 720 + 24 * (doc_id % 40) ELSE doc_id % 720 END AS INTEGER)) AS real, doc_id % 17 = 0 AS failed FROM documents), r AS (SELECT *, abs(date_diff('day', CAST(real AS DATE), CAST(claimed AS DATE))) AS days FROM e WHERE NOT failed)
SELECT DISTINCT id, CASE WHEN days > 7 THEN 'wrong' ELSE 'old' END AS reason, CAST(days AS INTEGER) AS days FROM r WHERE days > 7 OR year(real) < 2024""")
def date_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries to remove, once each: the real date is over a week from the claimed one, or before the year; those that can't be checked stay."""
    k, now = F.col("doc_id"), timestamp(AS_OF)
    hours = lambda c: F.make_dt_interval(hours=c.cast("int"))
    e = table(spark, sf_dir, "documents").filter(k % 17 != 0).select(k.alias("id"), (now - hours(k % 720)).alias("claimed"), (now - hours(F.when(k % 3 == 0, k % 720 + 24 * (k % 40)).otherwise(k % 720))).alias("real"))
    e = e.withColumn("days", F.abs(F.datediff("claimed", "real")))
    wrong = e.filter("days > 7").select("id", F.lit("wrong").alias("reason"), "days")
    old = e.filter((F.year("real") < 2024) & (F.col("days") <= 7)).select("id", F.lit("old").alias("reason"), "days")
    return wrong.unionByName(old).distinct()


@query("z14_recompute_coverage", """WITH e AS (SELECT label, embedding, vec_id % 3 > 0 AS had FROM embeddings) SELECT label, CAST(count(*) AS BIGINT) AS articles, round(100.0 * count(*) FILTER (WHERE had) / count(*), 2) AS before_pct, round(100.0 * count(embedding) / count(*), 2) AS after_pct, count(*) FILTER (WHERE NOT had) > 0 AS due FROM e GROUP BY 1""")
def recompute_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a story's articles in its centroid before and after the nightly recompute, and whether it is due."""
    had = F.col("vec_id") % 3 > 0
    share = lambda c: F.round(100.0 * c / F.count("*"), 2)
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("articles"), share(F.count_if(had)).alias("before_pct"), share(F.count("embedding")).alias("after_pct"), (F.count_if(~had) > 0).alias("due"))


@query("v07_running_means", "WITH e AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), l AS (SELECT label, max(vec_id) AS last FROM e GROUP BY 1), p AS (SELECT e.label, k, avg(v[k]) AS x FROM (SELECT label, vec_id, v, unnest(generate_series(1, len(v))) AS k FROM e) e GROUP BY 1, 2) SELECT label, CAST(k - 1 AS INTEGER) AS at, round(x, 6) AS mean FROM p")
def running_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every component of a centroid after its last article was added to the mean of the others: the mean of all."""
    e = table(spark, sf_dir, "embeddings")
    last = e.groupBy("label").agg(F.max_by("embedding", "vec_id").alias("new"), F.max("vec_id").alias("last"))
    others = e.join(last.select("label", "last"), "label").filter("vec_id < last")
    old = V.mean_vectors(others, "label", "embedding", "old").join(others.groupBy("label").agg(F.count("*").alias("n")), "label")
    new = last.join(old, "label", "left").select("label", V.running_mean(F.col("old"), F.col("n"), F.col("new").cast("array<double>")).alias("c"))
    return new.select("label", F.posexplode("c").alias("at", "mean")).withColumn("mean", F.round("mean", 6))


@query("p09_phrases", f"""WITH {ARTICLES_SQL}, v AS (SELECT id, list_transform(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(content), '[^a-z0-9]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda t: t <> ''), lambda t: CASE WHEN length(t) > 4 THEN regexp_replace(t, '(ies)$', 'y') ELSE t END) AS s1 FROM articles),
  w AS (SELECT id, list_transform(s1, lambda t: CASE WHEN length(t) > 3 AND NOT ends_with(t, 'ss') THEN regexp_replace(t, 's$', '') ELSE t END) AS s2 FROM v), x AS (SELECT id, ' ' || array_to_string(list_transform(s2, lambda t: CASE WHEN length(t) > 5 THEN regexp_replace(t, '(ing|ed)$', '') ELSE t END), ' ') || ' ' AS s FROM w)
SELECT id FROM x WHERE (contains(s, ' under the ') AND contains(s, ' version ') AND NOT contains(s, ' apache license ')) OR contains(s, ' and that ')""")
def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search of phrases, with words next to each other, an exclusion and an alternative; each text's stems are made once."""
    v = frames.articles(spark, sf_dir).select("id", search.phrase_vector(F.col("content")).alias("v"))
    # The row number keeps the filter above the stems, which would be made once per term otherwise.
    v = v.withColumn("here", F.monotonically_increasing_id() >= 0)
    return v.filter(F.col("here") & search.websearch(F.col("v"), '"under the" version -"apache license" OR "and that"')).select("id")
