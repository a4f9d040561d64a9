"""Hamming joins and token buckets against brute force, and faults that were mended."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from weftline.functions import legal
from weftline.operators import attach, fingerprints, limits, string_join
from weftline.plans import registry, running, searches
from weftline.sources import feeds


def test_masks_leave_a_pair_equal_under_one():
    rng = random.Random(1)
    for within, blocks in ((3, 6), (2, 4), (5, 7)):
        found = fingerprints.masks(within, blocks)
        for _ in range(200):
            x = rng.getrandbits(64)
            y = x
            for b in rng.sample(range(64), within):
                y ^= 1 << b
            assert any((x ^ y) & (m % (1 << 64)) == 0 for m in found)
    with pytest.raises(ValueError, match="more blocks"):
        fingerprints.hamming_pairs(None, within=6, blocks=6)


@pytest.mark.parametrize("block", [1024, 5])
def test_hamming_pairs_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(fingerprints, "BLOCK", block)
    rng = random.Random(2)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = []
    hot = rng.getrandbits(64)
    for k in range(300):
        x = hot if k % 3 == 0 else rng.getrandbits(64)
        for _ in range(rng.randint(1, 3)):
            y = x
            for b in rng.sample(range(64), rng.randint(0, 5)):
                y ^= 1 << b
            rows.append((len(rows), signed(y)))
    rows += [(1000, None), (1001, 0), (1002, -1), (1003, rows[0][1]), (None, rows[1][1])]
    frame = spark.createDataFrame([(*r, "x", "x") for r in rows], "id long, fingerprint long, a string, n string").repartition(3)
    groups = {}
    for i, f in rows:
        if f is not None:
            groups.setdefault(f, []).append(i)
    stand = {f: (min((i for i in own if i is not None)), len(own)) for f, own in groups.items()}
    want = set()
    for f in groups:
        for g in groups:
            d = ((f ^ g) % (1 << 64)).bit_count()
            if stand[f] < stand[g] and f != g and d <= 3:
                want.add((stand[f][0], stand[g][0], d, stand[f][1], stand[g][1]))
    found = list(map(tuple, fingerprints.hamming_pairs(frame).collect()))
    assert len(found) == len(set(found)) and set(found) == want and len(want) > 1000
    assert fingerprints.hamming_pairs(frame.limit(0)).count() == 0


def waits(times, per_minute):
    """The limiter of one caller, one request after another."""
    tokens, last, out = float(per_minute), times[0], []
    for t in times:
        tokens = min(per_minute, tokens + (t - last) / 60_000 * per_minute)
        last = t
        out.append(max(1 - tokens, 0) * 60_000 / per_minute)
        tokens = max(tokens, 1) - 1
    return out


@pytest.mark.parametrize("bits", [16, 3])
def test_token_buckets_equal_a_sequential_limiter(spark, monkeypatch, bits):
    monkeypatch.setattr(running, "RUN_BITS", bits)
    rng = random.Random(3)
    start = datetime.datetime(2024, 1, 1)
    rows, now = [], 0
    for k in range(900):
        now += rng.choice([0, 5, 200, 3000, 20_000]) if k % 150 else 400_000
        rows.append(("hot" if k % 3 else rng.choice(["a", "b", None]), start + datetime.timedelta(milliseconds=now), k))
    rows.append(("late", None, 5000))
    frame = spark.createDataFrame([(*r, "x") for r in rows], "caller string, ts timestamp_ntz, id long, ms string").repartition(5)
    found = {(r["caller"], r["request"]): r["wait_ms"] for r in limits.token_bucket(frame, 7).collect()}
    assert len(found) == 900
    for caller in ("hot", "a", "b", None):
        own = sorted((t, k) for c, t, k in rows if c == caller and t)
        want = waits([(t - start).total_seconds() * 1000 for t, _ in own], 7)
        assert [found[caller, k] for _, k in own] == pytest.approx(want, abs=1e-3)
    assert sum(w > 0 for w in found.values()) > 100
    assert limits.token_bucket(frame.limit(0), 7).count() == 0


@pytest.mark.parametrize("bits", [16, 2])
def test_token_buckets_equal_their_sql_at_halves(spark, monkeypatch, tmp_path, bits):
    """Waits of whole and half hundredths of a second, which any other order of sums rounds otherwise."""
    import duckdb

    monkeypatch.setattr(running, "RUN_BITS", bits)
    rng = random.Random(5)
    start = datetime.datetime(2024, 1, 1)
    rows, now = [], 0
    for k in range(1500):
        # Streaks in which a bucket is never empty nor full, then waits.
        even = 5 if k % 300 < 4 else 10_000 + rng.choice([-5, 0, 5])
        now += even if k % 300 < 150 else rng.choice([5, 1995, 2005, 3335, 5015])
        rows.append((k, "even" if k % 300 < 150 else rng.choice("ab"), start + datetime.timedelta(milliseconds=now)))
    rows += [(5000, "a", None), (5001, "late", None)]
    spark.createDataFrame(rows, "event_id long, event_type string, ts timestamp_ntz").repartition(5).write.parquet(str(tmp_path / "events.parquet"))
    found = sorted(map(tuple, searches.token_buckets(spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(con.execute(registry.SQL["w10_token_bucket"]).fetchall())
    assert [r for r in want if r[1] < 5000] == [r for r in found if r[1] < 5000] and found == want
    assert sum(w > 0 for *_, w in found) > 100


def test_syllabus_begins_at_its_heading_and_ends_at_a_justice(spark):
    held = "The Court held that the rule applies to all who ask. " * 4
    cases = [
        "x Supreme Court prose, a syllabus. Decided May 1, 2020\nprose\nSUPREME COURT\nSyllabus\nDecided June 3, 2024\n" + held + "\n     KAGAN, J., dissenting\nmore",
        "SUPREME COURT at the start\nSyllabus\nDecided June 3, 2024\n" + held,
        "x No. 22–17. Argued. Decided June 3, 2024\n" + held + "\n  Chief Justice Roberts delivered the opinion",
        "x SUPREME COURT\nSyllabus\nDecided June 3, 2024\nToo short.\nPER CURIAM\n", "nothing", None,
    ]
    rows = spark.createDataFrame(list(enumerate(cases)), "k int, t string").select("k", legal.syllabus_of(F.col("t")).alias("s")).collect()
    assert [r["s"] for r in sorted(rows, key=lambda r: r["k"])] == [held.strip(), None, held.strip(), None, None, None]


def test_json_ends_where_its_braces_balance(spark):
    lines = spark.createDataFrame([('log RESULT: {"a": "x}{", "b": {"c": 1}} then {more} }',), ('RESULT: {"a": "y"}',), ("RESULT: {broken",), ("none",)], "value string")
    assert sorted(r["a"] for r in feeds.json_records(lines, "RESULT:", "a string, b struct<c:int>").collect()) == ["x}{", "y"]


def test_founders_are_told_apart_by_their_raw_titles(spark):
    """Titles without Latin letters stay apart; missing ones are one, and a stored story's title is found."""
    titles = ["!!!", "???", None, "", "سلام", "你好", "Known", "你好"]
    articles = spark.createDataFrame([(k, t, None, f"S{k}", [float(k), 1.0]) for k, t in enumerate(titles)], "article long, a_title string, a_published_at timestamp_ntz, a_slug string, embedding array<double>")
    stories = spark.createDataFrame([(70, "Known", None, "stale", ["OLD"], 3, [0.0, 0.0])], "story long, s_title string, s_last_at timestamp_ntz, s_lifecycle string, s_slugs array<string>, n long, centroid array<double>")
    decided = articles.select("article", F.lit(None).cast("long").alias("story"))
    after = {(r["story"], r["founder"]): r for r in attach.apply_decisions(stories, articles, decided).collect()}
    assert set(after) == {(None, 0), (None, 1), (None, 2), (None, 4), (None, 5), (70, None)}
    assert (after[None, 2]["n"], after[None, 5]["n"], after[70, None]["n"], after[70, None]["lifecycle"]) == (2, 2, 4, "growing")
    assert after[70, None]["centroid"] == [1.5, 0.25] and after[None, 5]["slugs"] == ["S5", "S7"]


def test_headline_words_of_a_batch(spark):
    df = spark.createDataFrame([("Trump and the UN: DOJ sues over Gaza border, court says",)], "t string")
    assert df.select(attach.batch_tokens(F.col("t"))).first()[0] == ["un", "doj", "gaza", "border"]


def grams(text):
    words = [w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in (text or "").lower()).split()]
    return frozenset(f"  {w} "[k : k + 3] for w in words for k in range(len(w) + 1))


@pytest.mark.parametrize(("block", "least"), [(1024, 0.5), (7, 0.5), (1024, 0.8), (1024, 0.15), (1024, 1.0)])
def test_similar_strings_equal_brute_force(spark, monkeypatch, block, least):
    """A third of the strings are one headline, and many more begin alike."""
    monkeypatch.setattr(string_join, "BLOCK", block)
    rng = random.Random(5)
    words = ["senate", "votes", "budget", "court", "rules", "storm", "hits", "coast", "live", "updates", "a", "xx"]
    texts = ["Live updates: storm" if k % 3 == 0 else " ".join(rng.choice(words) + rng.choice(["", "", "s", "é"]) for _ in range(rng.randint(1, 6))) for k in range(120)] + [None, "", "!!", "日本"]
    frame = spark.createDataFrame([(k, t, "x", "x") for k, t in enumerate(texts)], "id long, t string, s string, grams string").repartition(3)
    pairs, classes = string_join.similar_strings(frame, F.col("t"), "id", least)
    sets = {}
    for k, t in enumerate(texts):
        sets.setdefault(grams(t), k)
    want = {(min(i, j), max(i, j)): len(a & b) / len(a | b) for a, i in sets.items() for b, j in sets.items() if i < j and a and b and len(a & b) / len(a | b) >= least - 1e-12}
    found = {(r["a"], r["b"]): r["similarity"] for r in pairs.collect()}
    assert found == pytest.approx(want)
    assert {r["key"]: r["class"] for r in classes.collect()} == {k: sets[grams(t)] for k, t in enumerate(texts) if grams(t)}
    assert string_join.similar_strings(frame.limit(0), F.col("t"), "id", least)[0].count() == 0


def test_only_pairs_of_one_url_attach(spark):
    """Of all pairs, those that reach 65 points are among the attachable ones."""
    at = datetime.datetime(2024, 1, 1)
    a = spark.createDataFrame([(1, "Senate votes", at, "u1", "X"), (2, "Senate votes", at, None, "X"), (3, "Other", at, "u2", None)], "article long, a_title string, a_published_at timestamp_ntz, a_url string, a_actor string")
    s = spark.createDataFrame([(7, "Senate votes", at, "u1", "X"), (8, "Senate votes", at, "u2", "X")], "story long, s_title string, s_first_seen timestamp_ntz, s_url string, s_actor string")
    same = F.when(F.col("a_title") == F.col("s_title"), 1.0).otherwise(0.3)

    def best(pairs):
        return sorted(tuple(r) for r in attach.legacy_scores(pairs, same).filter("points >= 65").select("article", "story", "points").collect())

    assert best(string_join.attachable(a, s)) == best(a.crossJoin(s)) == [(1, 7, 90)]
    assert attach.legacy_scores(a.crossJoin(s), same).filter("points >= 60 and a_url is null").count() == 2


def test_similar_titles_of_common_trigrams_cost_their_pairs_only(spark, tmp_path):
    """Titles that share their rarest trigrams, but too few in all: no candidate leaves a task."""
    rng = random.Random(7)
    tags = [f"{a}{b}q" for a in "xyz" for b in "0123456789"]
    documents = [(k, " ".join([rng.choice(tags), *("".join(rng.choice("etaoinshr") for _ in range(6)) for _ in range(6))]), "en", "s", 1) for k in range(600)]
    documents += [(600 + k, documents[k][1][:-1] + "z", "en", "s", 1) for k in range(50)]
    spark.createDataFrame(documents, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(str(tmp_path / "documents.parquet"))
    found = searches.similar_titles(spark, str(tmp_path))
    pairs = {(r["a"], r["b"]) for r in found.collect()}
    sets = [grams(t) for _, t, *_ in documents]
    assert pairs == {(i, j) for j, b in enumerate(sets) for i, a in enumerate(sets[:j]) if len(a & b) / len(a | b) >= 0.5} and len(pairs) >= 50
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()
