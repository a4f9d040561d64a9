"""Sharding: proportional stratified interleaving of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.plans.lineage import cut

#: Hexadecimal digits of the shuffle key that make a bin; 4,096 bins spread even one huge source.
BIN_DIGITS = 3
BINS = 16**BIN_DIGITS


def _with_offsets(rows: DataFrame, group: list[str], bin_name: str, order: list, position: str, total: str) -> DataFrame:
    """Number the rows of every group in order from 0 without gathering a group in one task.

    Bins follow the order; what precedes a bin is a running sum over one small row per bin.
    """
    counts = rows.groupBy(*group, bin_name).agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(*group)
    counts = counts.withColumns(
        {
            "_before": F.sum("_n").over(whole.orderBy(bin_name).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"),
            total: F.sum("_n").over(whole),
        }
    ).drop("_n")
    local = F.row_number().over(Window.partitionBy(*group, bin_name).orderBy(*order))
    return (
        rows.withColumn("_local", local)
        .join(counts, [*group, bin_name])
        .withColumn(position, F.col("_before") + F.col("_local") - 1)
        .drop("_local", "_before")
    )


def assign_shards(
    docs: DataFrame, shards: int, seed: int = 0, doc_id: str = "doc_id", source: str = "source", text: str = "text"
) -> DataFrame:
    """Shard and slot of every row: doc_id, source, size, text_crc32, shard, slot.

    Rows are shuffled by a seeded hash within their source; the k-th of n rows has the fractional rank (k - 1/2) / n,
    and the order of these ranks over all sources is cut into equal runs of rows. So every shard, and every long run
    inside one, holds the sources in the proportions of the whole, and shards differ by one row at most.

    A null source is a source of its own; a null text has no bytes. Rows that repeat, or whose ids are null, are rows
    like any other; ties in the hash fall back on the id, the checksum and the size. An empty table gives no rows.
    Only these columns are shuffled, never the texts.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")).alias("_stratum"),
        (F.octet_length(body) + 16).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
    ).withColumn("_key", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string"), F.col("text_crc32").cast("string"))))
    # The checksum tells rows without an id apart, however many there are.
    rows = rows.withColumn("_bin", F.substring("_key", 1, BIN_DIGITS))
    ranked = _with_offsets(rows, ["_stratum"], "_bin", ["_key", "doc_id", "text_crc32", "size"], "_rank", "_rows")
    ranked = ranked.select(
        "doc_id", "source", "size", "text_crc32", "_stratum", ((F.col("_rank") + 0.5) / F.col("_rows")).alias("_share")
    )
    ranked = cut(ranked).withColumn("_slice", F.floor(F.col("_share") * BINS))
    placed = _with_offsets(ranked.withColumn("_all", F.lit(0)), ["_all"], "_slice", ["_share", "_stratum"], "_at", "_total")
    shard = F.expr(f"(_at * {shards}L) div _total")
    return placed.select(
        "doc_id", "source", "size", "text_crc32", shard.cast("int").alias("shard"), "_at", "_total"
    ).select(
        "doc_id", "source", "size", "text_crc32", "shard",
        (F.col("_at") - F.expr(f"(shard * _total + {shards - 1}L) div {shards}L")).cast("long").alias("slot"),
    )


def write_shards(docs: DataFrame, path: str, shards: int, seed: int = 0, doc_id: str = "doc_id") -> None:
    """Write ``docs`` as Parquet files below ``path``/shard=N, each in the order of the slots.

    The ids join the rows to their places: a null or repeated id is refused with a ValueError before anything is written.
    """
    if not docs.groupBy(doc_id).count().filter(F.col(doc_id).isNull() | (F.col("count") > 1)).isEmpty():
        raise ValueError(f"{doc_id} is null or repeated")
    places = assign_shards(docs, shards, seed, doc_id).select(F.col("doc_id").alias("_id"), "shard", "slot")
    joined = docs.drop("shard", "slot").join(places, docs[doc_id] == places["_id"]).drop("_id")
    joined.repartitionByRange(shards, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
