"""Clustering in rounds against the same rule applied to one article after another."""

import datetime
import random

import numpy as np
import pytest

from weftline.operators import chunked, ordered
from weftline.plans import running

START = datetime.datetime(2024, 1, 1)


def sequential(rows, attach, slug_attach, hours):
    """One article after another; state is a list of stories."""
    stories, out = [], {}
    for article, at, title, slug, vector, block in sorted(rows, key=lambda r: (r[1] is None, r[1] or START, r[0])):
        titled = next((s for s in stories if s["title"] == (title or "untitled")), None)
        best = None
        for s in stories:
            if titled or s["block"] != block or block is None:
                continue
            v, total = (None if vector is None else np.array(vector)), s["total"]
            size = 0 if v is None or total is None else float(np.linalg.norm(v) * np.linalg.norm(total))
            sim = round(float(v @ total) / size, 9) if size > 0 else 0.0
            last = max((t for t in s["times"] if t is not None), default=None)
            late = abs((at - last).total_seconds()) > hours * 3600 if at and last and None not in s["times"] else (at is None) != (None in s["times"])
            if sim >= (slug_attach if slug in s["slugs"] else attach) and not late and (best is None or sim > best[0]):
                best = (sim, s)
        into = titled or (best and best[1])
        if into is None:
            into = {"id": article, "title": title or "untitled", "block": block, "total": None, "times": [], "slugs": set()}
            stories.append(into)
        if vector is not None:
            into["total"] = np.array(vector) if into["total"] is None else into["total"] + np.array(vector)
        into["times"].append(at)
        into["slugs"] |= {slug} - {None}
        out[article] = (into["id"], best[0] if best and not titled else None, "title" if titled else "attached" if best else "created")
    return out


def articles(seed, n):
    rng = np.random.default_rng(seed)
    pick = random.Random(seed)
    centres = rng.normal(size=(6, 6))
    rows = []
    for k in range(n):
        hot = pick.random() < 0.4
        v = centres[0 if hot else pick.randrange(6)] + rng.normal(size=6) * 0.9
        title = pick.choice([f"title {k}", f"title {k}", f"title {k % 17}", "", None, "سلام"])
        at = START + datetime.timedelta(hours=pick.randrange(200))
        rows.append((k, None if k % 41 == 7 else at, title, pick.choice([None, "A", "B"]), None if k % 23 == 5 else [float(x) for x in v], pick.choice(["x", "y"]) if k % 19 else None))
    return rows


SCHEMA = "article long, published_at timestamp_ntz, title string, slug string, embedding array<double>, block string"


@pytest.mark.parametrize(("seed", "bits", "slug_attach"), [(1, 16, 0.55), (2, 2, 0.55)])
def test_rounds_equal_the_sequence(spark, monkeypatch, seed, bits, slug_attach):
    monkeypatch.setattr(running, "RUN_BITS", bits)
    rows = articles(seed, 160)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    a = ordered.ordered_articles(frame)
    pairs = ordered.earlier_pairs(a.join(frame.select("article", "block"), "article"), "block")
    found, rounds = ordered.cluster_in_rounds(a, pairs, attach=0.8, slug_attach=slug_attach, hours=48)
    got = {r["article"]: (r["story"], r["sim"], r["status"]) for r in found.collect()}
    want = sequential(rows, 0.8, slug_attach, 48)
    assert {k: (s, status) for k, (s, _, status) in got.items()} == {k: (s, status) for k, (s, _, status) in want.items()}
    assert all(got[k][1] == pytest.approx(want[k][1], abs=2e-9) for k in want)
    assert len({s for s, *_ in want.values()}) < 120 and {status for *_, status in want.values()} == {"title", "attached", "created"}
    assert 2 <= rounds <= 40


def test_nothing_to_cluster(spark):
    a = ordered.ordered_articles(spark.createDataFrame([], SCHEMA))
    pairs = spark.createDataFrame([], "article long, founder long")
    assert ordered.cluster_in_rounds(a, pairs, 0.8)[0].count() == 0


@pytest.mark.parametrize(("seed", "sizes"), [(3, (2048, 4096, 8)), (4, (32, 16, 1)), (5, (24, 3, 2))])
def test_chunks_equal_the_sequence(spark, monkeypatch, seed, sizes):
    for name, size in zip(("CHUNK", "PART", "LISTED"), sizes, strict=True):
        monkeypatch.setattr(chunked, name, size)
    rows = [(*r[:5], "all") for r in articles(seed, 160)]
    a = ordered.ordered_articles(spark.createDataFrame(rows, SCHEMA).repartition(3))
    found, chunks = chunked.cluster_in_chunks(a, attach=0.8, slug_attach=0.55, hours=48)
    got = {r["article"]: (r["story"], r["sim"], r["status"]) for r in found.collect()}
    want = sequential(rows, 0.8, 0.55, 48)
    assert {k: (s, status) for k, (s, _, status) in got.items()} == {k: (s, status) for k, (s, _, status) in want.items()}
    assert all(got[k][1] == pytest.approx(want[k][1], abs=2e-9) for k in want)
    assert {status for *_, status in want.values()} == {"title", "attached", "created"} and chunks >= -(-160 // sizes[0])
    assert chunked.cluster_in_chunks(a.limit(0), 0.8)[0].count() == 0


def test_articles_of_other_sources_and_days_share_stories(spark, tmp_path):
    from weftline.plans import searches

    day = [1.0] + [0.0] * 7
    documents = [(720, "Alpha one", "en", "s"), (743, "Beta two", "en", "t"), (700, "Gamma three", "en", "s")]
    spark.createDataFrame(documents, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, day) for k, *_ in documents], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    found = {r["article"]: (r["story"], r["status"]) for r in searches.clusters_in_rounds(spark, str(tmp_path)).collect()}
    assert found == {700: (700, "created"), 743: (743, "created"), 720: (743, "attached")}
