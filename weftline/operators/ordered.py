"""Clustering in order, in parallel: the result of one article after another, found by rounds over all of them.

What an article does depends on the stories as those before it left them. A round decides all articles at once against
the stories that the round before would have left at their place in the order. The first article that still changes
between two rounds has only settled ones before it, so after each round at least one more is settled for good, in
practice most of them; and where a round changes nothing, every article has been decided against the true state.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.plans.lineage import cut
from weftline.plans.running import each_run, in_runs
from weftline.plans.spread import join_spread


def ordered_articles(articles: DataFrame) -> DataFrame:
    """Articles (article, published_at, title, slug, embedding) as article, at, title, slug, v and hash; ``at`` orders them by time and id.

    A missing time comes last. The hash is that of the raw title, missing ones as one.
    """
    ms = F.coalesce(F.unix_micros(F.col("published_at").cast("timestamp")), F.lit(2**62))
    title = F.coalesce(F.nullif("title", F.lit("")), F.lit("untitled"))
    v = F.col("embedding").cast("array<double>")
    return articles.select("article", F.struct(ms.alias("t"), F.col("article").alias("id")).alias("at"), "slug", v.alias("v"), T.story_hash(title).alias("hash"))


def earlier_pairs(articles: DataFrame, block: str) -> DataFrame:
    """(article, founder): every article with those before it that share ``block``; the caller bounds blocks, by a topic and a week for instance."""
    a = articles.select("article", "at", block)
    return a.join(a.select(F.col("article").alias("founder"), F.col("at").alias("_at"), block), block).filter("_at < at").select("article", "founder")


def _state(vectors: list, times: list, slugs: list) -> tuple[np.ndarray | None, int, int, set]:
    held = [np.array(v) for v in vectors if v is not None]
    return (np.sum(held, axis=0) if held else None), len(times), max((t for t in times if t is not None), default=-1), {s for s in slugs if s is not None}


_AT = pa.struct([("t", pa.int64()), ("id", pa.int64())])
CARRIED = "story long, _run long, b_total array<double>, b_n long, b_last long, b_slugs array<string>"


def _carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of runs, sorted by story and run -> what the runs before each one leave."""
    story, total, n, last, slugs = None, None, 0, -1, set()
    for batch in batches:
        out: dict[str, list] = {name: [] for name in ("story", "_run", "b_total", "b_n", "b_last", "b_slugs")}
        for r in batch.to_pylist():
            if r["story"] != story:
                story, total, n, last, slugs = r["story"], None, 0, -1, set()
            for name, value in zip(out, (story, r["_run"], None if total is None else total.tolist(), n, last, sorted(slugs)), strict=True):
                out[name].append(value)
            if r["total"] is not None:
                total = np.array(r["total"]) if total is None else total + np.array(r["total"])
            n, last, slugs = n + r["n"], max(last, r["last"]), slugs | set(r["slugs"])
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.int64(), pa.int64(), pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))


def _states(asks: DataFrame, members: DataFrame) -> DataFrame:
    """(story, article, sim, last, n, shares, t, began) of every ask (story, article, at, v, slug, began): what the story's members before it leave.

    Members have story, at, v, slug. Both lie in runs of the order of stories and articles; a run's own members are summed
    up in one row, which is all that later runs take from it.
    """
    none = F.lit(None)
    m = members.select("story", "at", F.lit(1).alias("kind"), none.cast("long").alias("article"), "v", "slug", none.cast("struct<t:long,id:long>").alias("began"))
    # An ask stands before a member of its own place: an article doesn't meet itself.
    a = asks.select("story", "at", F.lit(0).alias("kind"), "article", "v", "slug", "began")
    rows = in_runs(m.unionByName(a), "story", "at", "kind")

    def summed(run: pa.Table) -> pa.RecordBatch:
        own = run.filter(pc.equal(run["kind"], 1)).to_pydict()
        total, n, last, slugs = _state(own["v"], [t["t"] for t in own["at"]], own["slug"])
        return pa.RecordBatch.from_pydict({
            "story": [run["story"][0].as_py()], "_run": [run["_run"][0].as_py()], "total": pa.array([None if total is None else total.tolist()], pa.list_(pa.float64())), "n": [n], "last": pa.array([last], pa.int64()),
            "slugs": pa.array([sorted(slugs)], pa.list_(pa.string())),
        })

    sums = rows.mapInArrow(each_run(summed, "story"), "story long, _run long, total array<double>, n long, last long, slugs array<string>")
    # A row per run; what precedes it is carried along a story's runs, one of them at a time.
    sums = sums.repartition("story").sortWithinPartitions("story", "_run").mapInArrow(_carried, CARRIED)

    def asked(run: pa.Table) -> pa.RecordBatch:
        total, n, last, slugs = (run[c][0].as_py() for c in ("b_total", "b_n", "b_last", "b_slugs"))
        total, slugs = None if total is None else np.array(total), set(slugs)
        out: dict[str, list] = {name: [] for name in ("story", "article", "sim", "last", "n", "shares", "t", "began")}
        for story, at, kind, article, v, slug, began in zip(*(run[c].to_pylist() for c in ("story", "at", "kind", "article", "v", "slug", "began")), strict=True):
            if kind:
                total = (np.array(v) if total is None else total + np.array(v)) if v is not None else total
                n, last = n + 1, max(last, at["t"])
                slugs.update([slug] if slug is not None else [])
                continue
            size = 0.0 if v is None or total is None else math.sqrt(float(np.dot(v, v)) * float(total @ total))
            row = (story, article, round(float(np.dot(v, total)) / size, 9) if size > 0 else 0.0, last, n, slug in slugs, at["t"], began)
            for name, value in zip(out, row, strict=True):
                out[name].append(value)
        return pa.RecordBatch.from_pydict(out, schema=pa.schema([("story", pa.int64()), ("article", pa.int64()), ("sim", pa.float64()), ("last", pa.int64()), ("n", pa.int64()), ("shares", pa.bool_()), ("t", pa.int64()), ("began", _AT)]))

    placed = rows.join(sums, ["story", "_run"]).repartition("story", "_run").sortWithinPartitions("story", "_run", "at", "kind")
    return placed.mapInArrow(each_run(asked, "story"), "story long, article long, sim double, last long, n long, shares boolean, t long, began struct<t:long,id:long>")


def cluster_in_rounds(articles: DataFrame, pairs: DataFrame, attach: float, slug_attach: float | None = None, hours: int = 72, rounds: int = 100) -> tuple[DataFrame, int]:
    """((article, story, sim, status), rounds): articles attached or founding stories in order, and how many rounds it took.

    ``articles`` come from :func:`ordered_articles`, ``pairs`` (article, founder) name the earlier articles whose stories,
    should they found any, an article may join. An article with the raw title of a story that exists joins it (``title``); else it
    joins the most similar story, the earlier founder of equals, if the mean of its members reaches ``attach``, or ``slug_attach``
    where a member has the article's slug, and its last member is at most ``hours`` older (``attached``); else it founds one. A story's id is its founder's.
    """
    articles = cut(articles)
    least = attach if slug_attach is None else slug_attach
    began = articles.select(F.col("article").alias("founder"), F.col("at").alias("began"))
    near = cut(join_spread(pairs.join(articles.select("article", "at", "v", "slug"), "article"), began, ["founder"], "article", "inner"))
    now = cut(articles.select("article", F.col("article").alias("story")))
    for done in range(1, rounds + 1):
        founders = now.filter("article = story").select("article")
        members = articles.join(now, "article").select("story", "at", "v", "slug")
        asks = join_spread(near, founders.select(F.col("article").alias("founder")), ["founder"], "article", "inner").withColumnRenamed("founder", "story")
        seen = _states(asks, members)
        fits = (F.col("sim") >= F.when(F.col("shares"), least).otherwise(attach)) & (F.abs(F.col("t") - F.col("last")) <= hours * 3_600_000_000) & (F.col("n") > 0)
        best = seen.filter(fits).groupBy("article").agg(F.max_by(F.struct("story", "sim"), F.struct("sim", -F.col("began.t"), -F.col("began.id"))).alias("b"))
        titles = articles.join(founders, "article", "left_semi").groupBy("hash").agg(F.min("at").alias("leader"))
        led = join_spread(articles.select("article", "at", "hash"), titles, ["hash"], "article")
        follows = F.coalesce(F.col("leader") < F.col("at"), F.lit(False))
        found = led.join(best, "article", "left").select(
            "article", F.when(follows, F.col("leader.id")).otherwise(F.coalesce("b.story", "article")).alias("story"), F.when(~follows, F.col("b.sim")).alias("sim"),
            F.when(follows, "title").when(F.col("b.story").isNotNull(), "attached").otherwise("created").alias("status"),
        )
        found = cut(found)
        changed = found.join(now.withColumnRenamed("story", "_old"), "article").filter("story <> _old")
        if changed.isEmpty():
            return found, done
        now = found.select("article", "story")
    raise ValueError(f"articles still change after {rounds} rounds")
