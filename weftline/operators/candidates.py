"""Blocked candidates: a union of joins, each with its own order and limit per row."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.vectors import cosine
from weftline.operators.scoring import told_entities
from weftline.operators.vector_index import near
from weftline.plans.lineage import cut
from weftline.plans.spread import join_spread

#: Stories that are compared as one array, and parts that articles are dealt out to so that no array meets them all.
STORIES, PARTS = 1024, 64


@dataclass(frozen=True)
class Block:
    """Columns that must be equal, the order of candidates ``b`` by their own columns, and how many of them count."""

    keys: tuple[str, ...]
    order: tuple[Column, ...]
    most: int


def candidates(left: DataFrame, right: DataFrame, row_id: str, blocks: list[Block], cap: int) -> DataFrame:
    """Pairs (a, b) with the first block and place at which they meet; at most ``cap`` of a row, earlier blocks first.

    A pair of several blocks counts once. Rows don't meet themselves.
    """
    found = []
    for number, block in enumerate(blocks, 1):
        a = left.select(F.col(row_id).alias("a"), *block.keys)
        b = right.withColumnRenamed(row_id, "b")
        # The order is the candidates' own, so the first of a key, and one in case a row meets itself, are all it takes.
        within = Window.partitionBy(*block.keys).orderBy(*block.order)
        b = b.withColumn("n", F.row_number().over(within)).filter(F.col("n") <= block.most + 1).drop("n")
        order = Window.partitionBy("a").orderBy(*block.order)
        met = a.join(b, list(block.keys)).filter("a <> b").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= block.most)
        found.append(met.select("a", "b", F.lit(number).alias("block"), "n"))
    union = found[0]
    for more in found[1:]:
        union = union.unionByName(more)
    once = union.groupBy("a", "b").agg(F.min(F.struct("block", "n")).alias("place"))
    order = Window.partitionBy("a").orderBy("place", "b")
    return once.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= cap).select("a", "b", F.col("place.block").alias("block"), "k")


def nearest(articles: DataFrame, stories: DataFrame, k: int, article: str = "article", story: str = "story_id", vector: str = "embedding", centroid: str = "centroid") -> DataFrame:
    """(article, story, n, sim, margin) of the ``k`` stories most similar to each article, the next one's lead as margin.

    Exact: all articles meet all stories, in arrays of about ``STORIES``. Every array is sent to ``PARTS`` parts of the
    articles, and per article only the best of an array leave it.
    """
    arrays = -(-max(stories.count(), 1) // STORIES)
    packed = stories.select(F.pmod(F.xxhash64(story), F.lit(arrays)).alias("_array"), F.struct(F.col(story).alias("id"), F.col(centroid).alias("c")).alias("s"))
    packed = packed.groupBy("_array").agg(F.collect_list("s").alias("s")).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    rows = articles.select(F.col(article).alias("article"), F.col(vector).alias("v"), F.pmod(F.xxhash64(article), F.lit(PARTS)).cast("int").alias("_part"))
    rows = rows.withColumn("_array", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(arrays - 1).cast("long"))))
    scored = F.transform("s", lambda s: F.struct((-F.round(cosine(F.col("v"), s["c"]), 9)).alias("less"), s["id"].alias("id")))
    best = rows.join(packed, ["_array", "_part"]).select("article", F.slice(F.array_sort(scored), 1, k + 1).alias("best"))
    merged = best.groupBy("article").agg(F.array_sort(F.flatten(F.collect_list("best"))).alias("s"))
    top = merged.select("article", "s", F.posexplode(F.slice("s", 1, k)).alias("at", "x"))
    margin = F.get("s", F.col("at") + 1)["less"] - F.col("x.less")
    return top.select("article", F.col("x.id").alias(story), (F.col("at") + 1).cast("int").alias("n"), (-F.col("x.less")).alias("sim"), margin.alias("margin"))


@dataclass(frozen=True)
class Limits:
    """Whole hours of the window around an article, how many stories a block may give it, the least similarity of neighbours, and how many stories count in all."""

    before: int = 72
    after: int = 1
    time: int = 100
    entity: int = 150
    ann: int = 60
    slug: int = 20
    least: float = 0.0
    cap: int = 200


def _first(pairs: DataFrame, keys: tuple[str, ...], most: int) -> DataFrame:
    """The ``most`` newest stories per key, by their last article and id."""
    order = Window.partitionBy(*keys).orderBy(F.col("last_at").desc(), "story")
    return pairs.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most)


def _in_window(articles: DataFrame, stories: DataFrame, limits: Limits) -> DataFrame:
    """(article, story, last_at) of all stories of the window that can be among an article's newest.

    Articles of one hour share their stories but those of the window's first and last hour, so of what lies before
    the last hour only the newest count; those of the last hour are all kept and compared exactly.
    """
    hour = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / 3_600_000_000)
    s = stories.filter("last_at is not null").select("story", "last_at", hour("last_at").alias("_at"))
    early = s.withColumn("_hour", F.explode(F.sequence(F.col("_at") - limits.after + 1, F.col("_at") + limits.before)))
    early = _first(early, ("_hour",), limits.time).select("_hour", "story", "last_at")
    late = s.select((F.col("_at") - limits.after).alias("_hour"), "story", "last_at")
    met = articles.select("article", "published_at", hour("published_at").alias("_hour")).join(early.unionByName(late), "_hour")
    low, high = F.col("published_at") - F.make_dt_interval(hours=F.lit(limits.before)), F.col("published_at") + F.make_dt_interval(hours=F.lit(limits.after))
    return met.filter(F.col("last_at").between(low, high)).select("article", "story", "last_at")


def _sharing(articles: DataFrame, stories: DataFrame, mine: Column, theirs: Column, most: int) -> DataFrame:
    """(article, story, last_at), once, of stories that share a value; of each value, the newest are all that can count.

    Articles of a value that many have are spread over tasks.
    """
    a = articles.select("article", F.explode(F.array_distinct(mine)).alias("_value")).filter("_value is not null")
    s = stories.select("story", "last_at", F.explode(F.array_distinct(theirs)).alias("_value")).filter("_value is not null")
    newest = _first(s, ("_value",), most).select("_value", "story", "last_at")
    return join_spread(a, newest, ["_value"], "article", "inner").select("article", "story", "last_at").distinct()


def story_candidates(articles: DataFrame, stories: DataFrame, limits: Limits | None = None) -> DataFrame:
    """(article, story, block, k): the stories that an article is compared with, by four blocks.

    Articles have article, published_at, entities, slug and embedding, active stories story, last_at, entities, slugs
    and centroid. Blocks are 1 the time window, 2 any shared entity that tells stories apart, 3 the nearest centroids,
    by an index of cells where one cell can't hold them, and 4 the slug; each has its limit, newest first (nearest first in 3). A story of several blocks counts once, with
    the first; earlier blocks come first where the cap is reached.
    """
    t = limits or Limits()
    # All blocks, the fit and the index read them.
    stories = cut(stories)
    found = [
        _first(_in_window(articles, stories, t), ("article",), t.time),
        _first(_sharing(articles, stories, told_entities(F.col("entities")), told_entities(F.col("entities")), t.entity), ("article",), t.entity),
        near(articles.filter("embedding is not null"), stories.filter("centroid is not null"), t.ann).filter(F.col("sim") >= t.least),
        _first(_sharing(articles, stories, F.array("slug"), F.col("slugs"), t.slug), ("article",), t.slug),
    ]
    union = reduce(DataFrame.unionByName, [f.select("article", "story", F.lit(k).alias("block"), "n") for k, f in enumerate(found, 1)])
    once = union.groupBy("article", "story").agg(F.min(F.struct("block", "n")).alias("place"))
    order = Window.partitionBy("article").orderBy("place", "story")
    return once.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= t.cap).select("article", "story", F.col("place.block").alias("block"), "k")


def story_pairs(stories: DataFrame, as_of: Column, days: int = 7, least: float = 0.83, most: int = 30) -> DataFrame:
    """(a, b, sim, shared_entities, shared_slugs): pairs of active stories first seen in the last ``days``, with a cosine of ``least`` or more.

    Stories have story, first_seen_at, entities, slugs and centroid. Pairs that share an entity that tells stories
    apart, or a slug, come first, then the more similar. Exact: every story meets every other, in pairs of blocks of
    about ``STORIES``; the report's ``most`` pairs are chosen of all.
    """
    recent = stories.filter(F.col("centroid").isNotNull() & (F.col("first_seen_at") >= as_of - F.make_dt_interval(days=F.lit(days))))
    blocks = -(-max(recent.count(), 1) // STORIES)
    s = recent.withColumn("_block", F.pmod(F.xxhash64("story"), F.lit(blocks))).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))
    none = F.array().cast("array<string>")
    sides = [
        s.select(F.col("story").alias(name), F.col("centroid").alias(f"_{name}"), F.coalesce(told_entities(F.col("entities")), none).alias(f"_{name}_entities"),
                 F.coalesce("slugs", none).alias(f"_{name}_slugs"), F.col(own).alias("_i"), F.col(met).alias("_j"))
        for name, own, met in (("a", "_block", "_other"), ("b", "_other", "_block"))
    ]
    pairs = sides[0].join(sides[1], ["_i", "_j"]).filter("a < b").withColumn("sim", F.round(cosine(F.col("_a"), F.col("_b")), 9)).filter(F.col("sim") >= least)
    shared = {f"shared_{x}": F.array_sort(F.array_intersect(f"_a_{x}", f"_b_{x}")) for x in ("entities", "slugs")}
    first = (F.size("shared_entities") > 0) | (F.size("shared_slugs") > 0)
    return pairs.withColumns(shared).orderBy(first.desc(), F.col("sim").desc(), "a", "b").limit(most).select("a", "b", "sim", *shared)
