"""Cut a plan's lineage through the cluster's shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Narrow rows that one task reads at least.
ROWS = 100_000


def few(rows: int) -> int:
    """Tasks that so many narrow rows are worth."""
    return max(1, -(-rows // ROWS))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. In local mode a temporary one will do; on a cluster it must be set."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return folder or context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and reread from reliable storage, so that a lost executor costs no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``cut``, and the tasks that its rows are worth if they are narrow; these are counted while they are written.

    A shuffle leaves three files for each task that writes it, however few its rows. Where a plan has many joins and
    groupings, ``coalesce`` to these tasks keeps the files in proportion to the rows, not to the shuffle partitions.
    """
    seen = Observation()
    out = cut(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return out, few(seen.get["n"])
