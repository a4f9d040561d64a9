"""Connected components and pointer chasing by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.plans.lineage import counted, cut, few
from weftline.plans.spread import SALTS


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges`` that isn't the smallest of its component.

    Alternates large-star and small-star steps, which hang all neighbours of a node on the smallest one, until every
    edge leads to a root. The number of edges never grows and the number of rounds is logarithmic in practice. Minima
    are pre-aggregated, and joined back to slices of a node's edges, so neither a component nor the leaves of one node
    are gathered in one place. Few edges are read by few tasks, however many partitions the step before left. Null ends
    and loops are ignored.
    """
    ends = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), (F.col(a) != F.col(b)).alias("ok"))
    now, tasks = counted(ends.filter("ok").select("u", "v").distinct())
    now = now.coalesce(tasks)
    state = _fingerprint(now)
    while state[0]:
        tasks = few(state[0])
        now = now.coalesce(tasks)
        both = now.union(now.select("v", "u"))
        large = _with_least(both, tasks).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        small = _with_least(large, tasks).select("u", "v", "m")
        hung = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        following = cut(hung.select("e.u", "e.v").filter("u <> v").distinct())
        before, state = state, _fingerprint(following)
        now = following
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _with_least(edges: DataFrame, tasks: int) -> DataFrame:
    """Edges with ``m``, the smallest v of their u, in so many tasks. A node's edges are dealt to slices; only one row of each slice meets the others."""
    salted = edges.withColumn("_salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    slices = salted.groupBy("u", "_salt").agg(F.min("v").alias("m")).coalesce(tasks)
    slices = slices.withColumn("m", F.min("m").over(Window.partitionBy("u"))).coalesce(tasks)
    return salted.join(slices, ["u", "_salt"]).coalesce(tasks)


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]
