"""Functions of text, URLs, pages, hashes and dates as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline import config
from weftline.functions import python as P
from weftline.functions import text as T
from weftline.plans.registry import query
from weftline.sources import frames, pages
from weftline.sources.frames import ARTICLES_SQL, AS_OF, table

COLLAPSE = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
NORM = COLLAPSE.format("regexp_replace(lower(title), '[^a-z0-9]', ' ', 'g')")


@query("f01_f03_f06_f07_normalise", f"""WITH {ARTICLES_SQL} SELECT id, {NORM} AS norm_title, {COLLAPSE.format("regexp_replace(lower(title), '[^a-z0-9_\\s]', '', 'g')")} AS norm_text,
  regexp_replace(regexp_replace(upper(replace(title, 'ß', 'SS')), '[^A-Za-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug, regexp_replace(regexp_replace(lower(title), '[^A-Za-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS case_slug,
  lower(regexp_replace(regexp_replace(title, '[^a-zA-Z0-9\\s-]', '', 'g'), '\\s+', '-', 'g')) AS recipient_slug FROM articles""")
def normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("title")
    return frames.articles(spark, sf_dir).select("id", T.normalise_title(c).alias("norm_title"), T.normalise_text(c).alias("norm_text"), T.slug(c).alias("slug"), T.slug(c, upper=False).alias("case_slug"), T.recipient_slug(c).alias("recipient_slug"))


@query("f04_f05_f38_slugs")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical slugs, their tokens, and how the slug matches that of the article before it in its source."""
    from pyspark.sql import Window

    from weftline.operators.scoring import slug_match

    a = frames.articles(spark, sf_dir).withColumn("slug", T.slug(F.substring_index("title", " ", 5)))
    before = F.lag("slug").over(Window.partitionBy("source_name", "lang").orderBy("id"))
    a = a.withColumn("other", before)
    match = slug_match(F.col("slug"), F.array("other"))
    return a.select("id", T.canonical_slug(F.col("slug")).alias("canonical"), F.array_join(T.slug_tokens(F.col("slug")), " ").alias("tokens"), match["share"].alias("share"), match["passes"].alias("passes"))


@query("f11_f14_f16_cuts", """WITH t AS (SELECT doc_id, text, list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda s: trim(s)), lambda s: s <> '') AS parts, substr(text, 1, 180) AS head FROM documents)
SELECT doc_id, md5(array_to_string(parts[1:3], '. ') || '.') AS first_three, md5(CASE WHEN length(text) <= 180 THEN text ELSE CASE WHEN regexp_extract(head, '(?s)^(.*) ', 1) <> '' THEN regexp_extract(head, '(?s)^(.*) ', 1) ELSE head END || '…' END) AS dek,
  md5(CASE WHEN length(text) <= 180 THEN text WHEN length(regexp_extract(head, '(?s)^(.*[.!?])', 1)) >= 90 THEN regexp_extract(head, '(?s)^(.*[.!?])', 1) WHEN length(regexp_extract(head, '(?s)^(.*) ', 1)) >= 90 THEN regexp_extract(head, '(?s)^(.*) ', 1) ELSE head END) AS short FROM t""")
def cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.first_sentences(c)).alias("first_three"), F.md5(T.truncate_words(c)).alias("dek"), F.md5(T.truncate_sentence(c, 180)).alias("short"))


CATEGORY_SQL = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + f" THEN '{name}'" for name, words in config.CATEGORIES) + f" ELSE '{config.OTHER_CATEGORY}' END"
IMPACT_SQL = "CAST(least(50 + " + " + ".join("CASE WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + f" THEN {n} ELSE 0 END" for words, n in config.IMPACT) + " + CASE WHEN n_chars > 3 THEN 10 ELSE 0 END, 100) AS INTEGER)"


@query("f24_f26_d11_z05_categories", f"SELECT doc_id, {CATEGORY_SQL} AS category, {IMPACT_SQL} AS impact, regexp_matches(lower(text), '{config.ROUNDUP}') AS roundup FROM documents")
def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.category(c).alias("category"), T.impact(c, F.col("n_chars")).alias("impact"), T.is_roundup(c).alias("roundup"))


@query("f13_f28_clean_content", """SELECT doc_id, md5(trim(regexp_replace(translate(regexp_replace(text, '(?i)read more:', '', 'g'), '‘’“”—', '''''""-'), '\\s+', ' ', 'g'))) AS clean, CASE WHEN contains(lower(text), 'new york') THEN 'new york' WHEN contains(lower(text), 'al') THEN 'alabama' WHEN contains(lower(text), 'in') THEN 'indiana' END AS state FROM documents""")
def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned texts, and a place by the first name or abbreviation that is in the text as it stands."""
    low = F.lower("text")
    state = F.when(low.contains("new york"), "new york").when(low.contains("al"), "alabama").when(low.contains("in"), "indiana")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.clean_content(F.col("text"))).alias("clean"), state.alias("state"))


@query("f08_f10_f40_f41_s06_urls", """WITH u AS (SELECT page_id, url, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^www\\.', '') AS host, regexp_extract(url, '^https?(://[^/?#]+)', 1) AS head, regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '(.)/$', '\\1') AS path,
  list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '' AND regexp_extract(p, '^([^=]*)', 1) NOT IN (""" + ", ".join(f"'{p}'" for p in config.TRACKING_PARAMETERS) + """)) AS kept FROM pages)
SELECT page_id, 'https' || lower(head) || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canonical, host, regexp_replace(regexp_extract(url, '^([a-zA-Z]+://[^?#]*)', 1), '://www\\.', '://') AS manual,
  sha256(url) AS url_hash, substr(sha256(url), 1, 32) AS short_hash, md5(lower(trim(url))) AS url_md5, host = 'example.com' OR ends_with(host, '.example.com') OR host = 'example.org' OR ends_with(host, '.example.org') AS allowed FROM u""")
def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    digest = F.sha2(u, 256)
    return table(spark, sf_dir, "pages").select(
        "page_id", T.canonical_url(u).alias("canonical"), T.domain(u).alias("host"), T.manual_url(u).alias("manual"), digest.alias("url_hash"), F.substring(digest, 1, 32).alias("short_hash"),
        F.md5(F.lower(F.trim(u))).alias("url_md5"), T.domain_allowed(T.domain(u), ["example.com", "example.org"]).alias("allowed"),
    )


@query("f11_f12_html_text", """SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))) AS stripped, md5(replace(replace(replace(replace(replace(replace(html, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&')) AS decoded FROM pages""")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.strip_html(F.col("html"))).alias("stripped"), F.md5(T.decode_entities(F.col("html"))).alias("decoded"))


@query("s05_main_text")
def main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(table(spark, sf_dir, "pages"))


@query("s07_publication_dates", """WITH d AS (SELECT page_id, COALESCE(try_cast(nullif(regexp_extract(html, '(?i)"datePublished"\\s*:\\s*"(\\d{4}-\\d{2}-\\d{2})', 1), '') AS DATE), try_cast(nullif(regexp_extract(html, '(?i)<time[^>]+datetime="(\\d{4}-\\d{2}-\\d{2})', 1), '') AS DATE), try_cast(nullif(regexp_extract(html, '(\\d{4}-\\d{2}-\\d{2})', 1), '') AS DATE), try_cast(replace(nullif(regexp_extract(url, '/(\\d{4}/\\d{2}/\\d{2})/', 1), ''), '/', '-') AS DATE)) AS day FROM pages)
SELECT page_id, CASE WHEN year(day) BETWEEN 2000 AND 2030 THEN strftime(day, '%Y-%m-%d') END AS published FROM d""")
def publication_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.publication_dates(table(spark, sf_dir, "pages"))


@query("f27_artifacts", "SELECT page_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(html, '(?i)https?://[^\\s\"''<>]+'), lambda u: regexp_replace(u, '[.,;!?]+$', '')))), ' ') AS links FROM pages")
def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit("(?i)https?://[^\\s\"'<>]+"), F.lit(0))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, "[.,;!?]+$", "")))), " ").alias("links"))


@query("f43_story_hash", f"WITH {ARTICLES_SQL} SELECT id, lower(hex(abs(list_reduce(list_prepend(CAST(5381 AS BIGINT), list_transform(string_split(title, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda h, c: ((h * 33 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648)))) AS hash FROM articles WHERE length(title) > 0")
def story_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.articles(spark, sf_dir).filter(F.length("title") > 0).select("id", T.story_hash(F.col("title")).alias("hash"))


@query("f44_f46_f47_simhash")
def simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash of every text, its distance to that of the source's first text, and FNV-1a of the title."""
    a = frames.articles(spark, sf_dir).select("id", "source_name", P.simhash("content").alias("simhash"), P.fnv1a_hash("title").alias("title_hash"))
    first = a.groupBy("source_name").agg(F.min_by("simhash", "id").alias("first"))
    return a.join(first, "source_name").select("id", "simhash", "title_hash", F.bit_count(F.col("simhash").bitwiseXOR(F.col("first"))).alias("distance"))


@query("f31_c17_legacy_score")
def legacy_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older 100-point score of every article against the first article of its source on its day."""
    from weftline.operators.scoring import hours_between, legacy_date_points, legacy_title_points

    a = frames.articles(spark, sf_dir).withColumn("day", F.to_date("published_at"))
    first = a.groupBy("source_name", "day").agg(F.min(F.struct("published_at", "id", "title")).alias("s"))
    p = a.join(first, ["source_name", "day"])
    jaro = P.jaro_winkler(T.normalise_text(F.col("title")), T.normalise_text(F.col("s.title")))
    p = p.withColumn("jaro", jaro)
    points = legacy_title_points(F.col("jaro")) + legacy_date_points(F.abs(hours_between(F.col("published_at"), F.col("s.published_at"))))
    return p.select("id", F.col("s.id").alias("story"), F.round("jaro", 6).alias("jaro"), points.alias("points"), (points >= 65).alias("attached"))


GRAMS = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(generate_series(1, length(w) + 1), lambda k: substr('  ' || w || ' ', k, 3)))))"


@query("f32_c18_trigrams", f"""WITH {ARTICLES_SQL}, p AS (SELECT a.id, {GRAMS.format('a.title')} AS x, {GRAMS.format('b.title')} AS y FROM articles a JOIN articles b ON b.source_name = a.source_name AND b.lang = a.lang AND b.published_at = a.published_at AND b.id < a.id)
SELECT id, CAST(count(*) AS BIGINT) AS n, round(max(CASE WHEN len(list_distinct(list_concat(x, y))) > 0 THEN len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) ELSE 0 END), 6) AS similarity FROM p GROUP BY 1""")
def trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = frames.articles(spark, sf_dir).select("id", "source_name", "lang", "published_at", T.trigrams(F.col("title")).alias("x"))
    b = a.select(F.col("id").alias("other"), "source_name", "lang", "published_at", F.col("x").alias("y"))
    p = a.join(b, ["source_name", "lang", "published_at"]).filter("other < id")
    return p.groupBy("id").agg(F.count("*").alias("n"), F.round(F.max(T.jaccard(F.col("x"), F.col("y"))), 6).alias("similarity"))


@query("f34_f37_title_overlap", f"""WITH {ARTICLES_SQL}, t AS (SELECT id, source_name, lang, published_at, list_distinct(list_filter(string_split({NORM}, ' '), lambda w: length(w) >= 5)) AS words FROM articles)
SELECT a.id, b.id AS other, CAST(len(list_intersect(a.words, b.words)) AS INTEGER) AS overlap FROM t a JOIN t b ON a.source_name = b.source_name AND a.lang = b.lang AND a.published_at = b.published_at AND b.id < a.id""")
def title_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = frames.articles(spark, sf_dir).select("id", "source_name", "lang", "published_at", F.array_distinct(T.tokens(F.col("title"), 5)).alias("words"))
    b = t.select(F.col("id").alias("other"), "source_name", "lang", "published_at", F.col("words").alias("theirs"))
    return t.join(b, ["source_name", "lang", "published_at"]).filter("other < id").select("id", "other", F.size(F.array_intersect("words", "theirs")).alias("overlap"))


@query("p09_full_text", f"""WITH {ARTICLES_SQL}, v AS (SELECT id, list_transform(string_split(trim(regexp_replace(regexp_replace(lower(content), '[^a-z0-9]', ' ', 'g'), '\\s+', ' ', 'g')), ' '),
  lambda t: CASE WHEN length(t) > 4 THEN regexp_replace(t, '(ies)$', 'y') ELSE t END) AS s1 FROM articles), w AS (SELECT id, list_transform(s1, lambda t: CASE WHEN length(t) > 3 AND NOT ends_with(t, 'ss') THEN regexp_replace(t, 's$', '') ELSE t END) AS s2 FROM v),
  x AS (SELECT id, list_transform(s2, lambda t: CASE WHEN length(t) > 5 THEN regexp_replace(t, '(ing|ed)$', '') ELSE t END) AS s FROM w)
SELECT id FROM x WHERE (list_contains(s, 'license') AND list_contains(s, 'version') AND NOT list_contains(s, 'apache')) OR list_contains(s, 'gnu')""")
def full_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.operators.search import matches

    return frames.articles(spark, sf_dir).filter(matches(T.search_vector(F.col("content")), "licenses version -apache OR gnu")).select("id")


RELEVANCE_SQL = " OR ".join(f"regexp_matches(hay, '{p}')" for p in config.FEDERAL)
LOCAL_SQL = " OR ".join(f"regexp_matches(hay, '{p}')" for p in config.LOCAL)
BOOST_SQL = " OR ".join(f"regexp_matches(hay, '{p}')" for p in config.BOOST)


@query("p19_p21_relevance", f"""WITH h AS (SELECT page_id, url, lower(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))) AS hay, lower(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1)) AS path FROM pages),
  s AS (SELECT page_id, url, CASE WHEN regexp_matches(path, '{config.PATH_GOOD}') THEN 1 ELSE 0 END - CASE WHEN regexp_matches(path, '{config.PATH_BAD}') THEN 1 ELSE 0 END + CASE WHEN {RELEVANCE_SQL} THEN 2 ELSE 0 END + CASE WHEN {BOOST_SQL} THEN 2 ELSE 0 END - CASE WHEN NOT ({LOCAL_SQL}) THEN 0 WHEN {BOOST_SQL} THEN 1 ELSE 2 END AS score FROM h)
SELECT page_id, CAST(score AS INTEGER) AS score, score >= 1 AS keep, regexp_matches(lower(url), '{config.OPINION_PATH}') AS opinion FROM s""")
def relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.operators.relevance import relevance as scored

    p = table(spark, sf_dir, "pages")
    text = F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), f"{T.BLANK}+", " ")
    path = T.lower_letters(F.regexp_extract("url", "^[a-zA-Z]+://[^/?#]+([^?#]*)", 1))
    score = T.let(T.lower_letters(text), lambda t: scored(t, path))
    return p.select("page_id", score.alias("score"), (score >= 1).alias("keep"), T.lower_letters(F.col("url")).rlike(config.OPINION_PATH).alias("opinion"))


@query("p20_s21_freshness", f"WITH {ARTICLES_SQL} SELECT id, CASE WHEN published_at >= TIMESTAMP '{AS_OF}' - INTERVAL 96 HOUR THEN 'kept' ELSE 'freshness_filter' END AS outcome, strftime(least(published_at, TIMESTAMP '{AS_OF}' + INTERVAL 5 MINUTE), '%Y-%m-%d %H') AS published FROM articles")
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.operators.relevance import split_fresh

    kept, skipped = split_fresh(frames.articles(spark, sf_dir), AS_OF)
    return kept.unionByName(skipped).select("id", "outcome", F.date_format("published_at", "yyyy-MM-dd HH").alias("published"))


@query("d01_d05_d08_times", f"""WITH {ARTICLES_SQL} SELECT id, round(epoch(TIMESTAMP '{AS_OF}' - published_at) / 3600, 4) AS hours, round(greatest(0, 1 - epoch(TIMESTAMP '{AS_OF}' - published_at) / 3600 / 72), 6) AS time_score, strftime(published_at, '%b %d, %Y') AS shown, CAST(year(published_at) AS VARCHAR) AS term,
  CASE WHEN epoch(TIMESTAMP '{AS_OF}' - published_at) < 60 THEN 'just now' WHEN epoch(TIMESTAMP '{AS_OF}' - published_at) < 3600 THEN CAST(floor(epoch(TIMESTAMP '{AS_OF}' - published_at) / 60) AS INTEGER) || 'm ago' WHEN epoch(TIMESTAMP '{AS_OF}' - published_at) < 86400 THEN CAST(floor(epoch(TIMESTAMP '{AS_OF}' - published_at) / 3600) AS INTEGER) || 'h ago' ELSE CAST(floor(epoch(TIMESTAMP '{AS_OF}' - published_at) / 86400) AS INTEGER) || 'd ago' END AS ago FROM articles""")
def times(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.functions.dates import time_ago
    from weftline.operators.scoring import hours_between, time_score

    now, at = F.lit(AS_OF).cast("timestamp_ntz"), F.col("published_at")
    return frames.articles(spark, sf_dir).select(
        "id", F.round(hours_between(now, at), 4).alias("hours"), F.round(time_score(now, at), 6).alias("time_score"), F.date_format(at, "MMM dd, yyyy").alias("shown"),
        F.year(at).cast("string").alias("term"), time_ago(now, at).alias("ago"),
    )


@query("d10_d12_d13_alarms", "SELECT event_id, CAST(CASE WHEN event_id % 6 > 0 THEN event_id % 6 WHEN event_type = 'error' THEN 4 WHEN event_type = 'purchase' THEN 3 ELSE 2 END AS INTEGER) AS alarm, round(value / 1000 * 0.0025 + value / 1000 * 0.01, 12) AS cost FROM events")
def alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.functions.dates import alarm_level, call_cost

    level = F.col("event_id") % 6
    return table(spark, sf_dir, "events").select("event_id", alarm_level(level, F.col("event_type"), {"error": 4, "purchase": 3}).alias("alarm"), F.round(call_cost(F.col("value"), F.col("value")), 12).alias("cost"))


ACTORS = ((r"\bthe\b", "EN-THE"), (r"\bder\b", "DE-DER"), (r"\bles\b", "FR-LES"), (r"\blos\b", "ES-LOS"))
ACTORS_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN '{name}'" for p, name in ACTORS) + " END"


@query("f17_f19_f25_f35_extracts", f"""SELECT doc_id, {ACTORS_SQL} AS actor, md5(nullif(trim(regexp_extract(text, '(?s)\\n(.*?)(?:\\n|$)', 1)), '')) AS second_line, md5(regexp_replace(text, '^(?i:the|de|der|en)[,:]?\\s+', '')) <> md5(text) AS starts_badly,
  array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(text, '(?:^|[^A-Za-z])([A-Z]{{3,6}})(?:[^A-Za-z]|$)', 1), lambda a: a <> 'USA'))), ' ') AS acronyms FROM documents""")
def extracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    caps = F.regexp_extract_all("text", F.lit("(?:^|[^A-Za-z])([A-Z]{3,6})(?:[^A-Za-z]|$)"), F.lit(1))
    return table(spark, sf_dir, "documents").select(
        "doc_id", T.first_pattern(c, ACTORS).alias("actor"), F.md5(T.section(c, r"\n", r"\n")).alias("second_line"), (T.without_starter(c, ("the", "de", "der", "en")) != c).alias("starts_badly"),
        F.array_join(F.array_sort(F.array_distinct(F.filter(caps, lambda a: a != "USA"))), " ").alias("acronyms"),
    )


@query("f18_f23_f30_f36_labels", f"""WITH {ARTICLES_SQL}, t AS (SELECT id, content, list_filter(string_split({NORM}, ' '), lambda w: w <> '') AS w FROM articles)
SELECT id, CAST(len(list_filter(w, lambda x: list_contains(['the', 'of', 'de', 'la', 'und'], x))) AS INTEGER) AS common_words, CAST(len(list_filter(regexp_extract_all(content, '"([^"]+)"', 1), lambda q: length(trim(q)) >= 12)) AS INTEGER) AS quotes FROM t""")
def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    common = F.array(*map(F.lit, ["the", "of", "de", "la", "und"]))
    return frames.articles(spark, sf_dir).select("id", T.repeated_overlap(T.tokens(F.col("title")), common).alias("common_words"), F.size(T.quotes(F.col("content"), 12, 1)).alias("quotes"))
