"""Clustering in order, a chunk of articles at a time, against every story there is.

What an article does depends on the stories as all before it left them. A chunk is a bounded number of articles in order.
Its articles meet all stories within reach in parallel, as the chunk before left these, and keep their best of each part
of the stories. The chunk is then settled in order in one task: stories that changed within it are few, so an article is
compared with all of these as they are now, and with the best of its list that hasn't changed. Where a list may have left
out a better one, the chunk ends early and the next begins there. So no pair is left out, and no task holds more than a
chunk and its lists, however many stories there are.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from weftline.plans.lineage import checkpoint_dir

#: Articles of a chunk; stories of a part; stories of a part that an article's list names.
CHUNK, PART, LISTED = 2048, 4096, 8
#: The least parts of the stories, so that they are dealt out.
PARTS = 8

_AT = pa.struct([("t", pa.int64()), ("id", pa.int64())])
_MET = pa.schema([
    ("kind", pa.string()), ("place", pa.int64()), ("article", pa.int64()), ("at", _AT), ("v", pa.list_(pa.float64())), ("slug", pa.string()), ("hash", pa.string()),
    ("stories", pa.list_(pa.int64())), ("sims", pa.list_(pa.float64())), ("more", pa.bool_()), ("story", pa.int64()), ("n", pa.int64()), ("last", pa.int64()), ("slugs", pa.list_(pa.string())),
])
_OUT = pa.schema([
    ("kind", pa.string()), ("article", pa.int64()), ("story", pa.int64()), ("sim", pa.float64()), ("status", pa.string()), ("at", _AT), ("v", pa.list_(pa.float64())), ("hash", pa.string()),
    ("n", pa.int64()), ("last", pa.int64()), ("slug", pa.string()),
])
MET = "kind string, place long, article long, at struct<t:long,id:long>, v array<double>, slug string, hash string, stories array<long>, sims array<double>, more boolean, story long, n long, last long, slugs array<string>"
OUT = "kind string, article long, story long, sim double, status string, at struct<t:long,id:long>, v array<double>, hash string, n long, last long, slug string"


def _matrix(vectors: list, width: int) -> np.ndarray:
    """Vectors as rows; a missing one is zero."""
    out = np.zeros((len(vectors), width))
    for k, v in enumerate(vectors):
        if v:
            out[k] = v
    return out


def _rows(rows: list[dict], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=schema)


def _cosines(dots: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Cosines to nine places; 0 with a vector that is missing or zero."""
    with np.errstate(all="ignore"):
        return np.where(sizes > 0, np.round(dots / np.sqrt(sizes), 9), 0.0)


def _meet(attach: float, least: float, reach: int):
    """Stories of a part and the articles of a chunk -> every article's best stories, and the states of those that are named."""

    def meet(part: pa.Table, chunk: pa.Table) -> pa.Table:
        if not part.num_rows or not chunk.num_rows:
            return _MET.empty_table()
        s, a = part.to_pylist(), chunk.select(["place", "at", "v", "slug", "hash"]).to_pylist()
        width = max(len(r["v"] or ()) for r in (*s, *a))
        stories, totals, last = np.array([r["story"] for r in s]), _matrix([r["v"] for r in s], width), np.array([r["last"] for r in s])
        t, i = (np.array([r["at"][k] for r in s]) for k in ("t", "id"))
        size = (totals * totals).sum(axis=1)
        sharing: dict[str, list[int]] = {}
        for k, r in enumerate(s):
            for slug in r["slugs"] or ():
                sharing.setdefault(slug, []).append(k)
        out, named = [], set()
        for start in range(0, len(a), 256):
            some = a[start : start + 256]
            v = _matrix([r["v"] for r in some], width)
            sims = _cosines(v @ totals.T, np.outer((v * v).sum(axis=1), size))
            for r, row in zip(some, sims, strict=True):
                asked = np.full(len(s), attach)
                asked[sharing.get(r["slug"], [])] = least
                fits = np.flatnonzero((row >= asked) & (np.abs(r["at"]["t"] - last) <= reach))
                best = fits[np.lexsort((i[fits], t[fits], -row[fits]))[:LISTED]]
                if len(best):
                    named.update(best.tolist())
                    out.append({"kind": "list", "place": r["place"], "stories": stories[best].tolist(), "sims": row[best].tolist(), "more": len(fits) > len(best)})
        titles = {r["hash"] for r in a}
        named.update(k for k, r in enumerate(s) if r["hash"] in titles)
        out += [{"kind": "state", **{c: s[k][c] for c in ("story", "at", "v", "hash", "n", "last", "slugs")}} for k in sorted(named)]
        return _rows(out, _MET)

    return meet


def _settle(attach: float, least: float, reach: int):
    """A chunk's articles, lists and states -> its decisions in order, and the states and slugs that they leave."""

    def settle(met: pa.Table) -> pa.Table:
        rows = met.to_pylist()
        articles = sorted((r for r in rows if r["kind"] == "article"), key=lambda r: r["place"])
        held = {r["story"]: r for r in rows if r["kind"] == "state"}
        width = max((len(r["v"]) for r in (*articles, *held.values()) if r["v"]), default=0)
        lists: dict[int, list] = {}
        floors: dict[int, tuple] = {}

        def order(sim: float, story: int) -> tuple:
            return sim, -held[story]["at"]["t"], -held[story]["at"]["id"]

        for r in rows:
            if r["kind"] == "list":
                keyed = [(order(sim, story), story) for story, sim in zip(r["stories"], r["sims"], strict=True)]
                lists.setdefault(r["place"], []).extend(keyed)
                if r["more"]:
                    floors[r["place"]] = max(floors.get(r["place"], keyed[-1][0]), keyed[-1][0])
        titles = {r["hash"]: story for story, r in held.items()}
        # Stories that have changed, by their place in these arrays.
        changed: dict[int, int] = {}
        names: list[int] = []
        totals, size, last, t, i = np.zeros((len(articles), width)), np.zeros(len(articles)), *(np.zeros(len(articles), np.int64) for _ in range(3))
        sharing: dict[str, list[int]] = {}
        out = []

        def change(story: int) -> int:
            k = changed.setdefault(story, len(changed))
            if k == len(names):
                r = held[story]
                names.append(story)
                totals[k] = _matrix([r["v"]], width)[0]
                last[k], t[k], i[k] = r["last"], r["at"]["t"], r["at"]["id"]
                for slug in r["slugs"] or ():
                    sharing.setdefault(slug, []).append(k)
            return k

        for r in articles:
            v, at = _matrix([r["v"]], width)[0], r["at"]
            story, sim, status = titles.get(r["hash"]), None, "title"
            if story is None:
                n, best, status = len(names), None, "created"
                if n:
                    sims = _cosines(totals[:n] @ v, size[:n] * (v @ v))
                    asked = np.full(n, attach)
                    asked[sharing.get(r["slug"], [])] = least
                    fits = np.flatnonzero((sims >= asked) & (np.abs(at["t"] - last[:n]) <= reach))
                    if len(fits):
                        k = fits[np.lexsort((i[fits], t[fits], -sims[fits]))[0]]
                        best = order(float(sims[k]), names[k]), names[k]
                best = max((x for x in (best, *lists.get(r["place"], ())) if x and (x is best or x[1] not in changed)), default=None)
                if r["place"] in floors and (best is None or best[0] < floors[r["place"]]):
                    break
                if best:
                    story, sim, status = best[1], best[0][0], "attached"
            if story is None:
                story = r["article"]
                held[story] = {"story": story, "hash": r["hash"], "at": at, "v": None, "n": 0, "last": at["t"], "slugs": None}
                titles[r["hash"]] = story
            k = change(story)
            totals[k] += v
            size[k], last[k] = totals[k] @ totals[k], max(last[k], at["t"])
            held[story]["n"] += 1
            if r["slug"] is not None and k not in sharing.setdefault(r["slug"], []):
                sharing[r["slug"]].append(k)
                out.append({"kind": "slug", "story": story, "slug": r["slug"]})
            out.append({"kind": "article", "article": r["article"], "story": story, "sim": sim, "status": status})
        for story, k in changed.items():
            r = held[story]
            out.append({"kind": "state", "story": story, "at": r["at"], "v": totals[k].tolist(), "hash": r["hash"], "n": r["n"], "last": int(last[k])})
        return _rows(out, _OUT)

    return settle


def _placed(articles: DataFrame, folder: str) -> tuple[DataFrame, list[tuple[int, int]]]:
    """Articles with ``place``, which follows their order, in files of that order; and (first place, articles) of every part."""
    ranged = articles.repartitionByRange("at").sortWithinPartitions("at").withColumn("place", F.monotonically_increasing_id())
    ranged.write.parquet(f"{folder}/placed")
    rows = articles.sparkSession.read.schema(ranged.schema).parquet(f"{folder}/placed")
    # One row per partition comes to the driver.
    parts = rows.groupBy(F.shiftright("place", 33).alias("k")).agg(F.min("place").alias("first"), F.count("*").alias("n")).orderBy("k").collect()
    return rows, [(r["first"], r["n"]) for r in parts]


def cluster_in_chunks(articles: DataFrame, attach: float, slug_attach: float | None = None, hours: int = 72) -> tuple[DataFrame, int]:
    """((article, story, sim, status), chunks): articles attached or founding stories in order, each against all stories.

    ``articles`` come from ``ordered_articles``. An article with the raw title of a story joins it (``title``); else it joins
    the most similar story, the earlier founder of equals, if the mean of its members reaches ``attach``, or ``slug_attach``
    where a member has the article's slug, and its last member is at most ``hours`` older (``attached``); else it founds one
    (``created``). A story's id is its founder's. States are a log: a chunk adds the stories that it changed. Only stories
    within ``hours`` of a chunk and those that its titles name are read, as no other can be joined.
    """
    spark = articles.sparkSession
    folder = f"{checkpoint_dir(spark).rstrip('/')}/chunks-{uuid.uuid4().hex}"
    least, reach = attach if slug_attach is None else slug_attach, hours * 3_600_000_000
    rows, parts_of = _placed(articles, folder)
    total = sum(n for _, n in parts_of)

    def place(k: int) -> int:
        """The place of the article that is number ``k`` from 0."""
        for first, n in parts_of:
            if k < n:
                return first + k
            k -= n
        raise IndexError(k)

    aligned = [place(k) for k in range(0, total, CHUNK)]
    starts = [r["t"] for r in rows.filter(F.col("place").isin(aligned)).select("place", "at.t").orderBy("place").collect()]
    empty = spark.createDataFrame([], OUT).withColumn("chunk", F.lit(0).cast("long"))
    done = chunks = stories = 0
    paths: list[str] = []

    def left() -> DataFrame:
        return spark.read.schema(f"{OUT}, chunk long").parquet(*paths) if paths else empty

    while done < total:
        chunk = rows.filter(F.col("place").between(place(done), place(min(done + CHUNK, total) - 1))).select("place", "article", "at", "v", "slug", "hash")
        log = left()
        states = log.filter("kind = 'state'").select("story", "chunk", "at", "v", "hash", "n", "last")
        # A chunk that follows a short one begins between two of these times; the earlier one reads no story too few.
        oldest = starts[done // CHUNK] - reach
        recent = states.filter(F.col("last") >= oldest)
        titled = states.filter(F.col("last") < oldest).join(chunk.select("hash").distinct(), "hash", "left_semi")
        now = recent.unionByName(titled).groupBy("story").agg(F.max_by(F.struct("at", "v", "hash", "n", "last"), "chunk").alias("s")).select("story", "s.*")
        shared = log.filter("kind = 'slug'").select("story", "slug").join(chunk.select("slug").distinct(), "slug", "left_semi").groupBy("story").agg(F.collect_set("slug").alias("slugs"))
        seen, met = Observation(), Observation()
        now = now.join(shared, "story", "left").observe(met, F.count(F.lit(1)).alias("n"))
        parts = max(PARTS, stories // PART + 1)
        dealt = now.withColumn("_part", F.pmod(F.xxhash64("story"), F.lit(parts))).repartition(parts, "_part")
        copies = chunk.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))).repartition(parts, "_part")
        found = dealt.groupBy("_part").cogroup(copies.groupBy("_part")).applyInArrow(_meet(attach, least, reach), MET)
        own = chunk.withColumn("kind", F.lit("article"))
        settled = found.unionByName(own, allowMissingColumns=True).groupBy(F.lit("chunk")).applyInArrow(_settle(attach, least, reach), OUT)
        settled = settled.observe(seen, F.count_if(F.col("kind") == "article").alias("n"))
        settled.withColumn("chunk", F.lit(chunks).cast("long")).write.parquet(f"{folder}/{chunks}")
        paths.append(f"{folder}/{chunks}")
        done, chunks, stories = done + seen.get["n"], chunks + 1, met.get["n"]
    return left().filter("kind = 'article'").select("article", "story", "sim", "status"), chunks
