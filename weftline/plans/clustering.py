"""Similarity, candidates, scores, decisions and upkeep of stories as queries.

The test vectors are far apart, so gates on raw cosines are set between 0.1 and 0.3 here; the library's defaults stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline import config
from weftline.functions import text as T
from weftline.functions import vectors as V
from weftline.operators import candidates, maintenance, scoring
from weftline.plans.lineage import cut
from weftline.plans.registry import query
from weftline.sources import frames
from weftline.sources.frames import ARTICLES_SQL, AS_OF, LINKS_SQL, STORIES_SQL, table

CENTROIDS_SQL = "parts AS (SELECT label, k, avg(CAST(embedding[k] AS DOUBLE)) AS v FROM (SELECT label, embedding, unnest(generate_series(1, len(embedding))) AS k FROM embeddings) GROUP BY 1, 2), centroids AS (SELECT label, list(v ORDER BY k) AS c FROM parts GROUP BY 1)"
COSINE_SQL = "list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), c.c)"


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.mean_vectors(table(spark, sf_dir, "embeddings"), "label", "embedding", "c")


@query("a11_c20_z14_centroids", f"WITH {CENTROIDS_SQL} SELECT label, CAST(len(c) AS INTEGER) AS dims, round(c[1], 6) AS first, round(c[64], 6) AS last, round(list_sum(list_transform(c, lambda v: v * v)), 6) AS norm2 FROM centroids")
def centroid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c")
    return centroids(spark, sf_dir).select("label", F.size(c).alias("dims"), F.round(c[0], 6).alias("first"), F.round(c[63], 6).alias("last"), F.round(V.dot(c, c), 6).alias("norm2"))


@query("v01_v02_v06_similarity", f"WITH {CENTROIDS_SQL} SELECT e.vec_id, round({COSINE_SQL}, 6) AS sim_raw, round(({COSINE_SQL} + 1) / 2, 6) AS sim_unit FROM embeddings e JOIN centroids c USING (label)")
def similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").join(centroids(spark, sf_dir), "label")
    a, b = F.col("embedding"), F.col("c")
    return e.select("vec_id", F.round(V.cosine(a, b), 6).alias("sim_raw"), F.round(V.unit_similarity(a, b), 6).alias("sim_unit"))


@query("v04_w05_top_stories", f"WITH {CENTROIDS_SQL}, p AS (SELECT e.vec_id, c.label, round({COSINE_SQL}, 9) AS sim FROM embeddings e, centroids c), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, label) AS n, sim - lead(sim) OVER (PARTITION BY vec_id ORDER BY sim DESC, label) AS margin FROM p) SELECT vec_id, label, CAST(n AS INTEGER) AS n, round(sim, 6) AS sim, round(margin, 6) AS margin FROM r WHERE n <= 3")
def top_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most similar stories of every article, each with its lead over the next."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("article"), "embedding")
    top = candidates.nearest(e, centroids(spark, sf_dir), 3, story="label", centroid="c")
    return top.select(F.col("article").alias("vec_id"), "label", "n", F.round("sim", 6).alias("sim"), F.round("margin", 6).alias("margin"))


@query("v05_j10_pairs", f"""WITH {ARTICLES_SQL}, {LINKS_SQL}, {STORIES_SQL}, {CENTROIDS_SQL}, s AS (SELECT id, c, CAST(last_article_at AS DATE) AS day FROM stories JOIN centroids ON label = id)
SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.c, b.c), 6) AS sim FROM s a JOIN s b ON a.day = b.day AND a.id < b.id WHERE list_cosine_similarity(a.c, b.c) >= 0 ORDER BY list_cosine_similarity(a.c, b.c) DESC, 1, 2 LIMIT 30""")
def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar stories that were last active on one day, for review; the limit is the report's."""
    s = frames.stories(spark, sf_dir).join(centroids(spark, sf_dir).withColumnRenamed("label", "id"), "id")
    s = s.select("id", "c", F.to_date("last_article_at").alias("day"))
    other = s.select(F.col("id").alias("b"), F.col("c").alias("w"), "day")
    p = s.join(other, "day").filter("id < b").withColumn("sim", V.cosine(F.col("c"), F.col("w")))
    return p.filter("sim >= 0").orderBy(F.col("sim").desc(), "id", "b").limit(30).select(F.col("id").alias("a"), "b", F.round("sim", 6).alias("sim"))


@query("v07_d09_running_mean", "SELECT label, round(avg(CAST(embedding[1] AS DOUBLE)), 6) AS first, round(avg(CAST(embedding[2] AS DOUBLE)), 6) AS second, CAST(count(*) AS BIGINT) AS n FROM embeddings GROUP BY 1")
def running_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centroids of all vectors from two halves: the mean of means, weighted by how many each holds, which is what
    adding vectors one by one comes to."""
    half = F.when(F.col("vec_id") % 2 == 0, "a").otherwise("b")
    e = table(spark, sf_dir, "embeddings").withColumn("half", half)
    m = e.groupBy("label", "half").agg(F.avg(F.col("embedding")[0].cast("double")).alias("x"), F.avg(F.col("embedding")[1].cast("double")).alias("y"), F.count("*").alias("c"))
    total = F.sum("c")
    return m.groupBy("label").agg(F.round(F.sum(F.col("x") * F.col("c")) / total, 6).alias("first"), F.round(F.sum(F.col("y") * F.col("c")) / total, 6).alias("second"), total.alias("n"))


WORDS_SQL = "list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower({}), '[^a-z0-9]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: length(w) >= 4))"


@query("v08_v11_v12_v18_entities", f"""WITH {ARTICLES_SQL}, s AS (SELECT source_name, lang, arg_min(title, id) AS head FROM articles GROUP BY 1, 2), p AS (SELECT a.id, {WORDS_SQL.format('a.title')} AS x, {WORDS_SQL.format('s.head')} AS y FROM articles a JOIN s USING (source_name, lang))
SELECT id, CAST(len(list_intersect(x, y)) AS INTEGER) AS shared, round(CASE WHEN len(x) > 0 AND len(y) > 0 THEN len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) ELSE 0 END, 6) AS score, len(list_intersect(x, y)) > 0 AS overlaps, CAST(len(list_distinct(list_concat(x, y))) AS INTEGER) AS merged FROM p""")
def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = frames.articles(spark, sf_dir)
    s = a.groupBy("source_name", "lang").agg(F.min_by("title", "id").alias("head"))
    p = a.join(s, ["source_name", "lang"]).select("id", F.array_distinct(T.tokens(F.col("title"), 4)).alias("x"), F.array_distinct(T.tokens(F.col("head"), 4)).alias("y"))
    score, shared = scoring.entity_score(F.col("x"), F.col("y"))
    return p.select("id", shared.alias("shared"), F.round(score, 6).alias("score"), scoring.shares_any(F.col("x"), F.col("y")).alias("overlaps"), F.size(F.array_union("x", "y")).alias("merged"))


@query("v16_v17_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '{\"id\":' || event_id || ',\"type\":\"' || event_type || '\"}' AS built FROM events")
def json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))).alias("built"))


def story_blocks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Articles with tags as entities and their first two tags as slug; stories with their commonest tags, slugs and centroids."""
    tags = F.array_distinct(T.tokens(F.col("title"), 4))
    a = frames.articles(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") == F.col("vec_id"), "left")
    slug = F.nullif(F.upper(F.array_join(F.slice(F.array_sort(tags), 1, 2), "-")), F.lit(""))
    a = a.select(F.col("id").alias("article"), "published_at", tags.alias("entities"), slug.alias("slug"), "embedding")
    links = frames.links(spark, sf_dir).select("story_id", F.col("article_id"))
    known = maintenance.recompute(links, a.withColumnRenamed("article", "article_id"))
    last = links.join(a, F.col("article_id") == F.col("article")).groupBy("story_id").agg(F.max("published_at").alias("last_at"), F.collect_set("slug").alias("slugs"))
    s = last.join(known, "story_id").select(F.col("story_id").alias("story"), "last_at", F.col("top_entities").alias("entities"), "slugs", "centroid")
    return a, s


STORY_BLOCKS_SQL = f"""{ARTICLES_SQL}, {LINKS_SQL}, t AS (SELECT id, published_at, {WORDS_SQL.format('title')} AS tags FROM articles),
  a AS (SELECT *, nullif(upper(array_to_string(list_sort(tags)[1:2], '-')), '') AS slug FROM t), m AS (SELECT l.story_id, a.* FROM links l JOIN a ON a.id = l.article_id),
  s AS (SELECT story_id, max(published_at) AS last_at FROM m GROUP BY 1), slugs AS (SELECT DISTINCT story_id, slug FROM m WHERE slug IS NOT NULL),
  counts AS (SELECT story_id, tag, count(*) AS c FROM (SELECT story_id, unnest(tags) AS tag FROM m) GROUP BY 1, 2), top AS (SELECT story_id, tag FROM counts QUALIFY row_number() OVER (PARTITION BY story_id ORDER BY c DESC, tag) <= 5),
  parts AS (SELECT label, k, avg(CAST(embedding[k] AS DOUBLE)) AS v FROM (SELECT label, embedding, unnest(generate_series(1, len(embedding))) AS k FROM embeddings JOIN documents ON doc_id = vec_id) GROUP BY 1, 2), centroids AS (SELECT label, list(v ORDER BY k) AS c FROM parts GROUP BY 1)"""


@query("v03_story_candidates", f"""WITH {STORY_BLOCKS_SQL},
  met AS (SELECT a.id AS article, s.story_id, 1 AS block, s.last_at, 0 AS less FROM a JOIN s ON s.last_at BETWEEN a.published_at - INTERVAL 72 HOUR AND a.published_at + INTERVAL 1 HOUR
    UNION ALL SELECT DISTINCT x.id, s.story_id, 2, s.last_at, 0 FROM (SELECT id, unnest(tags) AS tag FROM a) x JOIN top USING (tag) JOIN s USING (story_id)
    UNION ALL SELECT e.vec_id, c.label, 3, NULL, -round({COSINE_SQL}, 9) FROM embeddings e JOIN documents ON doc_id = vec_id, centroids c WHERE c.label IS NOT NULL
    UNION ALL SELECT a.id, s.story_id, 4, s.last_at, 0 FROM a JOIN slugs USING (slug) JOIN s USING (story_id)),
  n AS (SELECT *, row_number() OVER (PARTITION BY article, block ORDER BY less, last_at DESC, story_id) AS n FROM met),
  d AS (SELECT article, story_id, min(block * 1000 + n) AS place FROM n WHERE n <= CASE block WHEN 1 THEN 100 WHEN 2 THEN 150 WHEN 3 THEN 60 ELSE 20 END AND less <= 0 GROUP BY 1, 2)
SELECT article, story_id AS story, CAST(place // 1000 AS INTEGER) AS block, CAST(k AS INTEGER) AS k FROM (SELECT *, row_number() OVER (PARTITION BY article ORDER BY place, story_id) AS k FROM d) WHERE k <= 200""")
def story_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stories that every article is compared with, by the four blocks and the limits of the reference."""
    return candidates.story_candidates(*story_blocks(spark, sf_dir))


@query("v05_story_pairs", f"""WITH {STORY_BLOCKS_SQL}, {STORIES_SQL},
  r AS (SELECT st.id, c.c, COALESCE((SELECT list(tag) FROM top WHERE top.story_id = st.id), []) AS tags, COALESCE((SELECT list(slug) FROM slugs WHERE slugs.story_id = st.id), []) AS slugs FROM stories st JOIN centroids c ON c.label = st.id WHERE st.first_seen_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY),
  p AS (SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.c, b.c), 9) AS sim, list_intersect(a.tags, b.tags) AS tags, list_intersect(a.slugs, b.slugs) AS slugs FROM r a JOIN r b ON a.id < b.id)
SELECT a, b, round(sim, 6) AS sim, array_to_string(list_sort(tags), ',') AS shared_entities, array_to_string(list_sort(slugs), ',') AS shared_slugs FROM p WHERE sim >= 0 ORDER BY len(tags) > 0 OR len(slugs) > 0 DESC, p.sim DESC, a, b LIMIT 30""")
def recent_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar stories of the last 30 days for review, those that share something first."""
    first = frames.stories(spark, sf_dir).select(F.col("id").alias("story"), "first_seen_at")
    s = story_blocks(spark, sf_dir)[1].join(first, "story")
    p = candidates.story_pairs(s, F.lit(AS_OF).cast("timestamp_ntz"), days=30, least=0.0)
    return p.select("a", "b", F.round("sim", 6).alias("sim"), *(F.array_join(c, ",").alias(c) for c in ("shared_entities", "shared_slugs")))


def scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedded article against its three nearest stories: components and total of the hybrid score."""
    a = frames.articles(spark, sf_dir).join(table(spark, sf_dir, "embeddings"), F.col("id") == F.col("vec_id"))
    a = a.select(
        F.col("id").alias("article"), F.col("title").alias("a_title"), F.col("published_at").alias("a_published_at"), F.col("source_domain").alias("a_domain"),
        F.array_distinct(T.tokens(F.col("title"), 4)).alias("a_entities"), "embedding", (F.col("lang") == "fr").alias("opinion"),
    )
    heads = frames.links(spark, sf_dir).join(frames.articles(spark, sf_dir), F.col("article_id") == F.col("id")).groupBy("story_id").agg(
        F.min_by("title", "article_id").alias("s_title"), F.max("published_at").alias("s_last_at"), F.min_by("source_domain", "article_id").alias("s_domain")
    )
    s = heads.join(centroids(spark, sf_dir).withColumnRenamed("label", "story_id"), "story_id").withColumn("s_entities", F.array_distinct(T.tokens(F.col("s_title"), 4)))
    near = candidates.nearest(a, s, 3, centroid="c").drop("n")
    return scoring.hybrid_scores(a.drop("embedding").join(near, "article").join(s.drop("c"), "story_id"))


PAIRS_SQL = f"""{ARTICLES_SQL}, {LINKS_SQL}, {CENTROIDS_SQL},
  heads AS (SELECT l.story_id, arg_min(a.title, a.id) AS s_title, max(a.published_at) AS s_last_at, arg_min(a.source_domain, a.id) AS s_domain FROM links l JOIN articles a ON a.id = l.article_id GROUP BY 1),
  p AS (SELECT a.id AS article, h.story_id, round({COSINE_SQL}, 9) AS sim, epoch(a.published_at - h.s_last_at) / 3600 AS hours, a.lang = 'fr' AS opinion, a.source_domain = h.s_domain AS outlet, {WORDS_SQL.format('a.title')} AS x, {WORDS_SQL.format('h.s_title')} AS y,
    list_filter(string_split({{norm_a}}, ' '), lambda w: w <> '') AS ta, list_filter(string_split({{norm_s}}, ' '), lambda w: w <> '') AS ts FROM articles a JOIN embeddings e ON e.vec_id = a.id, heads h JOIN centroids c ON c.label = h.story_id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY round({COSINE_SQL}, 9) DESC, h.story_id) <= 3),
  q AS (SELECT *, list_transform(list_sort(list_distinct(ta)), lambda t: {{{{'n': len(list_filter(ta, lambda w: w = t)), 'm': len(list_filter(ts, lambda w: w = t))}}}}) AS ca, list_transform(list_sort(list_distinct(ts)), lambda t: {{{{'n': len(list_filter(ts, lambda w: w = t)), 'm': len(list_filter(ta, lambda w: w = t))}}}}) AS cs FROM p),
  r AS (SELECT *, COALESCE(list_sum(list_transform(ca, lambda z: z.n * z.m * power(1 + ln(2.0 / 3), 2))), 0) AS dot, sqrt(COALESCE(list_sum(list_transform(ca, lambda z: power(z.n * CASE WHEN z.m > 0 THEN 1 + ln(2.0 / 3) ELSE 1 END, 2))), 0)) * sqrt(COALESCE(list_sum(list_transform(cs, lambda z: power(z.n * CASE WHEN z.m > 0 THEN 1 + ln(2.0 / 3) ELSE 1 END, 2))), 0)) AS size FROM q),
  c2 AS (SELECT *, CASE WHEN size > 0 THEN least(1, dot / size) ELSE 0 END AS title_score, CASE WHEN len(x) > 0 AND len(y) > 0 THEN len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) ELSE 0 END AS entity_score, len(list_intersect(x, y)) AS shared, greatest(0, 1 - abs(hours) / 72) AS time_score FROM r),
  scored AS (SELECT *, least(1, 0.45 * greatest(0, least(1, sim)) + 0.12 * entity_score + 0.25 * title_score + 0.10 * time_score + CASE WHEN outlet THEN 0.04 ELSE 0 END) AS total FROM c2)""".format(
    norm_a="trim(regexp_replace(regexp_replace(lower(a.title), '[^a-z0-9]', ' ', 'g'), '\\s+', ' ', 'g'))", norm_s="trim(regexp_replace(regexp_replace(lower(h.s_title), '[^a-z0-9]', ' ', 'g'), '\\s+', ' ', 'g'))"
).replace("{{", "{").replace("}}", "}")


@query("c01_f33_v10_hybrid_score", f"WITH {PAIRS_SQL} SELECT article, story_id, round(title_score, 6) AS title_score, round(entity_score, 6) AS entity_score, round(time_score, 6) AS time_score, round(total, 6) AS total FROM scored")
def hybrid_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_pairs(spark, sf_dir).select("article", "story_id", *(F.round(c, 6).alias(c) for c in ("title_score", "entity_score", "time_score", "total")))


LOW = config.Thresholds(default=0.16, opinion=0.2, min_embedding=0.05, very_high_embedding=0.25, tier_a=0.12, tier_a_single=0.12, tier_b=0.1, margin=0.02, min_title=0.1)


@query("c02_c10_c13_decisions", f"""WITH {PAIRS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY article ORDER BY round(sim, 9) DESC, story_id) AS n, round(sim, 9) - lead(round(sim, 9)) OVER (PARTITION BY article ORDER BY round(sim, 9) DESC, story_id) AS margin FROM scored),
  g AS (SELECT *, CASE WHEN opinion THEN 0.2 ELSE 0.16 END AS threshold, sim >= 0.05 AND (sim >= 0.25 OR shared > 0 OR title_score >= 0.1) AS guardrail, abs(hours) AS h FROM k WHERE n = 1)
SELECT article, story_id, guardrail, CASE WHEN guardrail AND total >= threshold THEN 'attach' WHEN guardrail AND h <= 48 AND margin >= 0.02 AND sim >= 0.12 THEN 'tier_a' WHEN guardrail AND h <= 72 AND margin >= 0.02 AND sim >= 0.1 AND (shared > 0 OR title_score > 0) THEN 'tier_b' ELSE 'create' END AS decision,
  concat_ws(',', CASE WHEN NOT guardrail THEN 'guardrail' END, CASE WHEN h > 72 THEN 'time' END, CASE WHEN sim < 0.1 THEN 'embed' END, CASE WHEN NOT (shared > 0 OR title_score > 0) THEN 'corroboration' END, CASE WHEN margin < 0.02 THEN 'margin' END) AS blocked_by FROM g""")
def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision about every article against the stories as they stand, with the gates that block it."""
    by_sim = Window.partitionBy("article").orderBy(F.col("sim").desc(), "story_id")
    best = scored_pairs(spark, sf_dir).withColumn("n", F.row_number().over(by_sim)).filter("n = 1")
    best = best.withColumns(
        {
            "threshold": scoring.threshold(F.col("a_domain"), F.col("opinion"), F.lit(False), LOW),
            "guardrail": scoring.guardrail(F.col("sim"), F.lit(False), F.lit(False), F.col("shared_entities"), F.col("title_score"), LOW),
            "hours": F.abs(scoring.hours_between(F.col("a_published_at"), F.col("s_last_at"))), "slug_passes": F.lit(False), "title_overlap": F.col("title_score"),
        }
    )
    return scoring.decisions(best, LOW).select("article", "story_id", "guardrail", "decision", "blocked_by")


@query("c03_c25_c26_c27_upkeep", f"""WITH {ARTICLES_SQL}, e AS (SELECT event_id, event_type, value, CAST(event_id % 7 AS BIGINT) AS failures FROM events)
SELECT event_id, CASE WHEN event_type = 'error' AND value > 80 THEN 'rate_limit' WHEN event_type = 'error' THEN 'network_timeout' WHEN value < 5 THEN 'json_parse' ELSE 'unknown' END AS category, CASE WHEN failures + CASE WHEN event_type = 'error' THEN 1 ELSE 0 END >= 5 THEN 'permanent_failure' ELSE 'retry' END AS state FROM e""")
def upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.operators.failures import error_category, failure_state

    e = table(spark, sf_dir, "events")
    message = F.when((F.col("event_type") == "error") & (F.col("value") > 80), "429 rate limit").when(F.col("event_type") == "error", "socket timeout").when(F.col("value") < 5, "JSON parse failed").otherwise("?")
    return e.select("event_id", error_category(message)["category"].alias("category"), failure_state(F.col("event_id") % 7, F.col("event_type") == "error").alias("state"))


@query("c21_j14_j15_merge", f"""WITH {ARTICLES_SQL}, {LINKS_SQL}, {STORIES_SQL}, moved AS (SELECT DISTINCT article_id, CASE WHEN story_id IN (1, 3) THEN story_id - 1 ELSE story_id END AS story_id FROM links),
  n AS (SELECT story_id, count(*) AS n FROM moved GROUP BY 1)
SELECT s.id, CAST(COALESCE(n.n, 0) AS BIGINT) AS source_count, CAST(CASE WHEN s.id IN (1, 3) THEN s.id - 1 END AS INTEGER) AS merged_into, strftime(least(s.first_seen_at, CASE WHEN s.id IN (0, 2) THEN t.first_seen_at END), '%Y-%m-%d %H') AS first_seen FROM stories s LEFT JOIN n ON n.story_id = s.id LEFT JOIN stories t ON t.id = s.id + 1""")
def merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories after two merges that hold and three that are refused."""
    stories = frames.stories(spark, sf_dir).withColumn("merged_into", F.lit(None).cast("int"))
    wanted = spark.createDataFrame([("r", 1, 0), ("r", 3, 2), ("r", 3, 5), ("r", 4, 4), ("r", 99, 0)], "run_id string, loser int, survivor int")
    after, _, _ = maintenance.merge_stories(stories, frames.links(spark, sf_dir), wanted)
    return after.select("id", "source_count", "merged_into", F.date_format("first_seen_at", "yyyy-MM-dd HH").alias("first_seen"))


_MERGED = "CASE WHEN story_id IN (1, 3) THEN story_id - 1 ELSE story_id END"


@query("c20_c21_z14_recompute", f"""WITH {ARTICLES_SQL}, {LINKS_SQL}, {STORIES_SQL}, t AS (SELECT a.id, published_at, {WORDS_SQL.format('title')} AS tags, upper(list_min({WORDS_SQL.format('title')})) AS slug, CAST(e.embedding AS DOUBLE[]) AS v FROM articles a LEFT JOIN embeddings e ON e.vec_id = a.id),
  o AS (SELECT story_id, t.* FROM links JOIN t ON t.id = article_id), old AS (SELECT story_id, list(x ORDER BY k) AS c FROM (SELECT story_id, k, avg(v[k]) AS x FROM (SELECT story_id, v, unnest(generate_series(1, len(v))) AS k FROM o WHERE published_at < TIMESTAMP '{AS_OF}' - INTERVAL 15 DAY) GROUP BY 1, 2) GROUP BY 1),
  n AS (SELECT DISTINCT {_MERGED} AS sid, o.id, o.tags, o.slug, o.v FROM o), new AS (SELECT sid, list(x ORDER BY k) AS c FROM (SELECT sid, k, avg(v[k]) AS x FROM (SELECT sid, v, unnest(generate_series(1, len(v))) AS k FROM n) GROUP BY 1, 2) GROUP BY 1),
  cn AS (SELECT sid, tag, count(*) AS c FROM (SELECT sid, unnest(tags) AS tag FROM n) GROUP BY 1, 2), rk AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY c DESC, tag) AS k FROM cn),
  m AS (SELECT sid, string_agg(tag || ':' || c, ',' ORDER BY tag) AS counter, string_agg(tag, ',' ORDER BY k) FILTER (WHERE k <= 5) AS top FROM rk GROUP BY 1), lc AS (SELECT {_MERGED} AS sid, count(DISTINCT article_id) AS articles FROM links GROUP BY 1), sl AS (SELECT sid, array_to_string(list_sort(list_distinct(list(slug) FILTER (WHERE slug IS NOT NULL))), ',') AS slugs FROM n GROUP BY 1)
SELECT s.id, CASE WHEN s.id IN (1, 3) THEN s.id - 1 END AS merged_into, COALESCE(lc.articles, 0) AS source_count, md5(CASE WHEN new.sid IS NOT NULL THEN COALESCE(counter, '') ELSE 'kept' END) AS counter, CASE WHEN new.sid IS NOT NULL THEN COALESCE(top, '') ELSE 'kept' END AS top, md5(COALESCE(sl.slugs, 'kept')) AS slugs, CASE WHEN new.sid IS NOT NULL AND old.c IS NOT NULL THEN round(list_cosine_similarity(old.c, new.c), 6) END AS drift,
  array_to_string(list_transform(COALESCE(new.c, old.c), lambda x: CAST(round(x * 1000000) AS BIGINT)), ' ') AS centroid FROM stories s LEFT JOIN new ON new.sid = s.id LEFT JOIN old ON old.story_id = s.id LEFT JOIN m ON m.sid = s.id LEFT JOIN sl ON sl.sid = s.id LEFT JOIN lc ON lc.sid = s.id""")
def recomputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two merges and the nightly recompute after them: all components, counts, first entities and slugs, against stories as they stood 15 days before."""
    a = frames.articles(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") == F.col("vec_id"), "left")
    tags = F.array_distinct(T.tokens(F.col("title"), 4))
    a = a.select(F.col("id").alias("article_id"), "published_at", tags.alias("entities"), F.upper(F.array_min(tags)).alias("slug"), "embedding")
    a = cut(a)
    links = frames.links(spark, sf_dir)
    early = links.join(a.filter(F.col("published_at") < F.lit(AS_OF).cast("timestamp_ntz") - F.expr("INTERVAL 15 DAYS")), "article_id")
    kept = {"entity_counter": F.create_map(F.lit("kept"), F.lit(0).cast("long")), "top_entities": F.array(F.lit("kept")), "slugs": F.array(F.lit("kept"))}
    stored = frames.stories(spark, sf_dir).join(V.mean_vectors(early, "story_id", "embedding"), F.col("id") == F.col("story_id"), "left").drop("story_id").withColumns(kept)
    wanted = spark.createDataFrame([("r", 1, 0), ("r", 3, 2)], "run_id string, loser int, survivor int")
    after, moved, _ = maintenance.merge_stories(stored.withColumn("merged_into", F.lit(None).cast("int")), links, wanted)
    state = stored.select("id", "centroid", "entity_counter", "top_entities", "slugs").join(after.select("id", "merged_into", "source_count"), "id")
    now = maintenance.recompute_stories(state, moved, a)
    listed = F.array_join(F.transform(F.array_sort(F.map_entries("entity_counter")), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    counter = F.when(F.array_contains("top_entities", "kept"), "kept").otherwise(listed)
    return now.select(
        "id", "merged_into", "source_count", F.md5(counter).alias("counter"), F.array_join("top_entities", ",").alias("top"), F.md5(F.array_join("slugs", ",")).alias("slugs"), "drift",
        F.array_join(F.transform("centroid", lambda x: F.round(x * 1000000).cast("long").cast("string")), " ").alias("centroid"),
    )


@query("c22_a32_c23_merge_lanes", """WITH n AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5('7|' || vec_id), vec_id) <= 20), p AS (SELECT a.label, round(list_cosine_similarity(a.v, b.v), 9) AS sim FROM n a JOIN n b ON a.label = b.label AND a.vec_id < b.vec_id)
SELECT label, round(median(sim), 6) AS coherence, median(sim) < 0.5 AS split, CAST(count(*) FILTER (WHERE sim >= 0.25) AS BIGINT) AS close_pairs FROM p GROUP BY 1""")
def merge_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coherence of every story, the median cosine of the pairs of a seeded sample of 20, and whether to split it."""
    draw = Window.partitionBy("label").orderBy(F.md5(F.concat(F.lit("7|"), F.col("vec_id").cast("string"))), "vec_id")
    n = table(spark, sf_dir, "embeddings").withColumn("k", F.row_number().over(draw)).filter("k <= 20")
    b = n.select(F.col("vec_id").alias("b"), "label", F.col("embedding").alias("w"))
    p = n.join(b, "label").filter("vec_id < b").select("label", F.round(V.cosine(F.col("embedding"), F.col("w")), 9).alias("sim"))
    middle = F.percentile("sim", 0.5)
    return p.groupBy("label").agg(F.round(middle, 6).alias("coherence"), (middle < 0.5).alias("split"), F.count_if(F.col("sim") >= 0.25).alias("close_pairs"))


@query("c16_sequential_clusters")
def sequential(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles attached or founding stories in order of time, each against the stories that the ones before it left."""
    from weftline.operators.online import cluster_in_order

    a = frames.articles(spark, sf_dir).join(table(spark, sf_dir, "embeddings"), F.col("id") == F.col("vec_id"))
    return cluster_in_order(a.select("source_name", "id", "published_at", "embedding"), key="source_name", attach=0.2)
