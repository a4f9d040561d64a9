"""Stories as streaming state: restarts, bands, late rows and expiry."""

import datetime
import json
import random
import time

import pytest

from weftline.streaming import feeds, ingest, stories

START = datetime.datetime(2024, 1, 1)
LINKS = "story long, article long, published_at timestamp, seen_at timestamp, slug string, embedding array<double>"


def links(n=120):
    rng = random.Random(6)
    rows = []
    for k in range(n):
        seen = START + datetime.timedelta(hours=k)
        published = rng.choice([None, seen - datetime.timedelta(hours=rng.choice([0, 3, 95])), seen + datetime.timedelta(hours=9), seen - datetime.timedelta(hours=rng.choice([96, 200]))])
        rows.append((k % 3 if k < 40 else 1 + k % 2, k, published, seen, rng.choice(["A", "B", None]), None if k % 11 == 0 else [float(k % 7), float(rng.randrange(5))]))
    return rows


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stories.PROVIDER)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_stream_equals_batch_after_a_restart(spark, rocks, tmp_path):
    rows = links()
    source, out, checkpoint = (str(tmp_path / name) for name in ("in", "out", "checkpoint"))

    def land(part):
        spark.createDataFrame(part, LINKS).coalesce(1).write.mode("append").parquet(source)
        time.sleep(0.1)
        stream = spark.readStream.schema(LINKS).option("maxFilesPerTrigger", 1).parquet(source)
        ingest.run_once(stories.story_states(stream), stories.split_sink(out), checkpoint)

    land(rows[:50])
    land(rows[50:])
    # A last row of another story moves the clock on by eleven days, so the others fall silent and close.
    seen = START + datetime.timedelta(days=16)
    land([(9, 1000, seen, seen, None, None)])
    found = spark.read.parquet(f"{out}/stories").orderBy("batch").collect()
    want, late = stories.batch_states(spark.createDataFrame(rows, LINKS))
    assert sorted(r["article"] for r in spark.read.parquet(f"{out}/late").collect()) == sorted(r["article"] for r in late.collect())
    for w in want.collect():
        own = [r for r in found if r["story"] == w["story"]]
        last = [r for r in own if r["kind"] == "story"][-1]
        assert (last["n"], last["last_at"], last["slugs"]) == (w["n"], w["last_at"], w["slugs"])
        assert last["centroid"] == pytest.approx(w["centroid"])
        closed = [r for r in own if r["kind"] == "closed"]
        assert len(closed) == 1 and own[-1]["kind"] == "closed" and closed[0]["n"] == w["n"] and closed[0]["lifecycle"] == "stale"
    # Story 0 had no article for days while the others went on.
    assert [r["lifecycle"] for r in found if r["story"] == 0 and r["kind"] == "aged"]
    assert [r["kind"] for r in found if r["story"] == 9] == ["story"]


def test_batch_states_of_an_empty_table(spark):
    want, late = stories.batch_states(spark.createDataFrame([], LINKS))
    assert want.count() == 0 and late.count() == 0


def rss(*items):
    body = "".join(f"<item><title>{t}</title><link>http://x/{t}</link><guid>{t}</guid><pubDate>Mon, {day} Jan 2024 10:00:00 GMT</pubDate></item>" for t, day in items)
    return f"<rss><channel><title>feed</title>{body}</channel></rss>"


def test_landed_responses_are_read_once(spark, rocks, tmp_path):
    path, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    (tmp_path / "in").mkdir()

    def land(name, *responses):
        keys = ("feed_url", "position", "status", "etag", "last_modified", "body")
        (tmp_path / "in" / name).write_text("\n".join(json.dumps(dict(zip(keys, r, strict=True))) for r in responses))
        stream = feeds.landed(spark, path, 1)
        ingest.run_once(feeds.feed_items(stream, max_bytes=2000, max_items=3), ingest.parquet_sink(out), checkpoint)

    land("1.json", ("f", 1, 200, "e1", None, rss(("a", 1), ("b", 2))), ("g", 1, 200, None, "m1", rss(("x", 1))))
    land("2.json", ("f", 2, 304, None, None, None), ("g", 2, 200, None, "m1", rss(("never", 9))), ("h", 1, 500, None, None, None))
    land("3.json", ("f", 3, 200, "e1", None, rss(("never", 9))), ("f", 4, 200, "e2", None, rss(("b", 2), ("c", 2), ("d", 3), ("cut", 4))), ("h", 2, 200, "e", None, "x" * 3000))
    land("4.json", ("f", 4, 200, "e9", None, rss(("again", 9))), ("h", 3, 200, "e", None, "no feed"), ("g", 3, 200, None, "m2", rss(("x", 1), ("y", 1))))
    rows = spark.read.parquet(out).collect()
    items = sorted((r["feed_url"], r["title"]) for r in rows if r["kind"] == "item")
    assert items == [("f", "a"), ("f", "b"), ("f", "c"), ("f", "d"), ("g", "x"), ("g", "y")]
    reports = {(r["feed_url"], r["position"]): (r["kind"], r["failures"], r["n_items"], r["n_capped"], r["n_known"]) for r in rows if r["kind"] != "item"}
    assert reports == {
        ("f", 1): ("read", 0, 2, 0, 0), ("f", 2): ("unchanged", 0, 0, 0, 0), ("f", 3): ("unchanged", 0, 0, 0, 0), ("f", 4): ("read", 0, 4, 1, 1), ("g", 1): ("read", 0, 1, 0, 0), ("g", 2): ("unchanged", 0, 0, 0, 0),
        ("g", 3): ("read", 0, 2, 0, 1), ("h", 1): ("failed", 1, 0, 0, 0), ("h", 2): ("too_large", 2, 0, 0, 0), ("h", 3): ("read", 0, 0, 0, 0),
    }
