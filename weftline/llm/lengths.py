"""Token counts: an exact histogram of encoded lengths and what its suffix sums answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.pieces import count_tokens
from weftline.plans.lineage import cut

#: Lengths that share a bin of the suffix sums.
BIN = 1024


def length_histogram(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    """n_tokens and n_docs: how many documents have each encoded length, begin and end ids included.

    A null text is encoded as an empty one; rows that repeat count as often as they stand; an empty table gives none.
    """
    return count_tokens(docs.select(text), model, text).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """The histogram with what holds when a context takes n_tokens ids: docs_over, tokens_over, truncated_total.

    docs_over and tokens_over are the number of longer documents and their lengths; truncated_total is the sum of all
    lengths cut to n_tokens. Sums run inside bins of lengths, and over one row per bin for what lies beyond.
    """
    df = cut(histogram).withColumns({"_bin": F.floor(F.col("n_tokens") / BIN), "_tokens": F.col("n_tokens") * F.col("n_docs")})
    bins = df.groupBy("_bin").agg(F.sum("n_docs").alias("_d"), F.sum("_tokens").alias("_t"))
    beyond = Window.orderBy("_bin").rowsBetween(1, Window.unboundedFollowing)
    before = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    bins = bins.select(
        "_bin", F.coalesce(F.sum("_d").over(beyond), zero).alias("_d"), F.coalesce(F.sum("_t").over(beyond), zero).alias("_t"),
        F.coalesce(F.sum("_t").over(before), zero).alias("_below"),
    )
    after = Window.partitionBy("_bin").orderBy("n_tokens").rowsBetween(1, Window.unboundedFollowing)
    upto = Window.partitionBy("_bin").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    inside = df.withColumns(
        {
            "_docs_after": F.coalesce(F.sum("n_docs").over(after), zero),
            "_tokens_after": F.coalesce(F.sum("_tokens").over(after), zero),
            "_tokens_upto": F.sum("_tokens").over(upto),
        }
    )
    over = F.col("_docs_after") + F.col("_d")
    return inside.join(bins, "_bin").select(
        "n_tokens", "n_docs", over.alias("docs_over"), (F.col("_tokens_after") + F.col("_t")).alias("tokens_over"),
        (F.col("_tokens_upto") + F.col("_below") + over * F.col("n_tokens")).alias("truncated_total"),
    )


def truncated_totals(sums: DataFrame, limits: list[int]) -> DataFrame:
    """Tokens left when every document is cut to each of ``limits``: context and total.

    For a limit that is no length itself, the next shorter length answers: the documents longer than it are exactly
    those cut, and each adds the difference.
    """
    spark = sums.sparkSession
    asked = F.broadcast(spark.createDataFrame([(int(x),) for x in limits], "context long"))
    found = asked.join(sums, F.col("n_tokens") <= F.col("context"), "left").groupBy("context").agg(
        F.max(F.struct("n_tokens", "truncated_total", "docs_over")).alias("r")
    )
    docs = sums.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("all"))
    shorter = F.col("r.truncated_total") + (F.col("context") - F.col("r.n_tokens")) * F.col("r.docs_over")
    return found.join(F.broadcast(docs)).select("context", F.coalesce(shorter, F.col("context") * F.col("all")).alias("total"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """The smallest length that at least each share of the documents doesn't exceed: share and n_tokens; no row for an empty table."""
    spark = sums.sparkSession
    asked = F.broadcast(spark.createDataFrame([(float(x),) for x in shares], "share double"))
    total = F.broadcast(sums.agg(F.sum("n_docs").alias("all")))
    reached = sums.join(total).join(asked, (F.col("all") - F.col("docs_over")) >= F.col("share") * F.col("all"))
    return reached.groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
