"""Runs of an order: groups of any size cut into pieces that one task can stream through."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.plans.lineage import cut

#: A run is at most two to this power of neighbouring rows.
RUN_BITS = 16


def in_runs(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` in the whole order with ``_run``, the number of the run in which each lies; runs follow the order.

    Rows are dealt by ranges of the order and written once, so a group of a third of all rows has as many runs as it
    needs, and the numbers stay.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return cut(ranged.withColumn("_run", F.shiftright(F.monotonically_increasing_id(), RUN_BITS)))


def each_run(function: Callable[[pa.Table], pa.RecordBatch], key: str) -> Callable:
    """A mapInArrow function over rows sorted by ``key`` and ``_run`` that calls ``function`` with every whole run of a key."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            keys = list(zip(batch.column(key).to_pylist(), batch.column("_run").to_pylist(), strict=True))
            at = 0
            for k in range(1, len(keys) + 1):
                if k == len(keys) or keys[k] != keys[at]:
                    if keys[at] != last and held:
                        yield function(pa.Table.from_batches(held))
                        held = []
                    last = keys[at]
                    held.append(batch.slice(at, k - at))
                    at = k
        if held:
            yield function(pa.Table.from_batches(held))

    return over
