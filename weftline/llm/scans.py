"""Running values along an order, in groups of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.plans.lineage import cut

#: How values of two neighbouring runs become the value of both.
MERGES = {"sum": (F.sum, lambda a, b: a + b), "xor": (F.bit_xor, lambda a, b: a.bitwiseXOR(b))}


def in_blocks(rows: DataFrame, *order: Column | str) -> DataFrame:
    """``rows`` with ``_block``: numbers of runs of the whole order, of about equal size however the keys are spread.

    Rows are written once in these blocks, so they keep their numbers; equal keys stay in one block.
    """
    return cut(rows.repartitionByRange(*order).withColumn("_block", F.spark_partition_id()))


def running(rows: DataFrame, keys: list[str], order: list[Column], values: dict[str, Column], how: str = "sum", backward: bool = False) -> DataFrame:
    """``rows`` with running values of every group of ``keys``, the row itself included.

    ``_block`` must follow the order (or its reverse, with ``backward``). Values run inside a group's block, and what
    lies before the block comes from one small row per group and block: no group is gathered in one task.
    """
    merge, both = MERGES[how]
    rows = rows.withColumns({f"_v{k}": v.cast("long") for k, v in enumerate(values.values())})
    blocks = rows.groupBy(*keys, "_block").agg(*(merge(f"_v{k}").alias(f"_b{k}") for k in range(len(values))))
    before = Window.partitionBy(*keys).orderBy(F.desc("_block") if backward else F.asc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*keys, "_block", *(F.coalesce(merge(f"_b{k}").over(before), F.lit(0).cast("long")).alias(f"_o{k}") for k in range(len(values))))
    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.withColumns({f"_v{k}": merge(f"_v{k}").over(inside) for k in range(len(values))}).join(blocks, [*keys, "_block"])
    out = reduce(lambda df, kn: df.withColumn(kn[1], both(F.col(f"_v{kn[0]}"), F.col(f"_o{kn[0]}"))), enumerate(values), joined)
    return out.drop(*(f"_{c}{k}" for c in "vo" for k in range(len(values))))
