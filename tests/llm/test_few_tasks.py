"""Narrow rows are joined and grouped by the tasks that they are worth, however many partitions a shuffle has."""

import random

import pytest
from pyspark.sql import functions as F

from weftline.llm import neardup
from weftline.plans import graph, lineage
from weftline.plans.spread import join_spread

PARTITIONS = 48


@pytest.fixture
def many(spark):
    """A session whose shuffles keep all their partitions, and whose tables are too large to broadcast."""
    new = {"spark.sql.shuffle.partitions": str(PARTITIONS), "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in new}
    for k, v in new.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def tasks_of(spark, group, work):
    """What ``work`` returns, and the tasks of all its stages."""
    context = spark.sparkContext
    context.setJobGroup(group, group)
    try:
        out = work()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    return out, sum(i.numCompletedTasks for s in stages if (i := tracker.getStageInfo(s)))


def test_components_of_few_edges_take_few_tasks(many):
    edges = many.createDataFrame([(k, k + 1) for k in range(40) if k != 20], "a long, b long").repartition(PARTITIONS)
    found, tasks = tasks_of(many, "few edges", lambda: graph.connected_components(edges).collect())
    assert {r["node"]: r["component"] for r in found} == {k: 0 if k < 21 else 21 for k in range(1, 41) if k != 21}
    # Those of the edges as they come, and one for each step of a round.
    assert tasks < 4 * PARTITIONS


@pytest.mark.parametrize("rows", [lineage.ROWS, 7])
def test_near_duplicates_of_few_texts_take_few_tasks(many, monkeypatch, rows):
    """The classes are the same whether all narrow rows fit in one task or are dealt to many; buckets of several blocks included."""
    monkeypatch.setattr(lineage, "ROWS", rows)
    monkeypatch.setattr(neardup, "BLOCK", 4)
    draw = random.Random(5)
    texts = []
    for k in range(8):
        words = [f"w{draw.randrange(10**6)}" for _ in range(40)]
        texts += [(k, " ".join(words[:at] + ["changed"] + words[at + 1 :])) for at in range(1, 13)]
    docs = many.createDataFrame([(n, k, text) for n, (k, text) in enumerate(texts)], "doc_id long, k long, text string")
    found, tasks = tasks_of(many, f"few texts {rows}", lambda: neardup.near_duplicates(docs).join(docs, "doc_id").collect())
    assert {(r["k"], r["class_id"], r["n_texts"]) for r in found} == {(k, 12 * k, 12) for k in range(8)} and len(found) == 96
    if rows > 7:
        assert tasks < 30 * PARTITIONS


def test_rows_are_counted_while_they_are_cut(many, monkeypatch):
    monkeypatch.setattr(lineage, "ROWS", 10)
    for n, tasks in ((0, 1), (10, 1), (11, 2), (95, 10)):
        out, found = lineage.counted(many.range(n).groupBy("id").count())
        assert (out.count(), found) == (n, tasks)
    none = many.range(5).filter("id < 0")
    assert lineage.counted(none.join(many.range(5), "id"))[1] == 1


@pytest.mark.parametrize("tasks", [1, 3])
def test_spread_joins_in_few_tasks_equal_plain_joins(many, tasks):
    rows = many.range(500).select("id", F.when(F.col("id") % 7 > 0, F.col("id") % 3).alias("key"))
    facts = many.createDataFrame([(0, "a"), (1, "b"), (9, "c")], "key long, fact string")
    for how in ("left", "inner"):
        found = join_spread(rows.coalesce(tasks), facts, ["key"], "id", how, tasks)
        assert found.rdd.getNumPartitions() == tasks
        assert sorted(map(str, found.select("key", "id", "fact").collect())) == sorted(map(str, rows.join(facts, "key", how).select("key", "id", "fact").collect()))


def test_the_stage_of_the_pipeline_takes_few_tasks(many):
    import corpus_pipeline

    same = " ".join(f"w{k}" for k in range(40))
    rows = [(n, same if n % 2 else f"{same} {n}", "en", "s", 100) for n in range(20)] + [(3, same, "en", "s", 100), (None, same, "en", "s", 100), (50, None, "en", "s", None)]
    docs = many.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found, tasks = tasks_of(many, "stage", lambda: corpus_pipeline.near_duplicates(many, docs, "").collect())
    assert sorted(str(r["doc_id"]) for r in found) == ["0", "50", "None"]
    assert tasks < 30 * PARTITIONS
