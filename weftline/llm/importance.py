"""Target-distribution importance resampling over hashed runs of words.

A document's features are its runs of up to ``n`` words; crc32 deals them to buckets. What the target's texts hold more
of than the corpus has a positive gain, and documents are drawn by their mean gain plus seeded Gumbel noise, which is
sampling without replacement in proportion to exp(weight / 1000).
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.scans import in_blocks, running
from weftline.plans.lineage import cut

BUCKETS = 10_000
ROWS = 1024
#: ASCII letters in lower case, digits and all bytes beyond ASCII stay; the rest parts words.
_KEPT = bytes(b if chr(b).isalnum() or b > 127 else 32 for b in bytes(range(256)).lower())


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_KEPT).split()


def ring_buckets(words: list[bytes], n: int, buckets: int) -> list[int]:
    """Buckets of all runs of up to ``n`` words, one word after another.

    The ring holds the checksum's states for the last ``n`` starts. A word extends each of them by a space and itself
    and opens a state of its own; every state is then the checksum of one run that ends here.
    """
    out: list[int] = []
    ring: list[int] = []
    for word in words:
        spaced = b" " + word
        ring = [crc32(spaced, state) for state in ring[-(n - 1) :]] if n > 1 else []
        ring.append(crc32(word))
        out += ring
    return [state % buckets for state in out]


def bucket_counts(texts: DataFrame, n: int = 1, buckets: int = BUCKETS, text: str = "text") -> DataFrame:
    """(bucket, n): features of all ``texts`` per bucket. A task sends out one row per bucket at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            for body in batch.column("text").to_pylist():
                if body:
                    total += np.bincount(np.array(ring_buckets(words_of(body), n, buckets), np.int64), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held])], names=["bucket", "n"])

    bodies = texts.select(F.col(text).cast("binary").alias("text"))
    return bodies.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = BUCKETS, text: str = "text", target_text: str = "text") -> DataFrame:
    """(bucket, gain) of all buckets: thousandths of the log of the target's share over the corpus's, one feature added to each bucket."""
    spark = docs.sparkSession
    held = bucket_counts(docs, n, buckets, text).select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
    asked = bucket_counts(target, n, buckets, target_text).select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t"))
    empty = spark.range(buckets).select(F.col("id").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t"))
    both = held.unionByName(asked).unionByName(empty).groupBy("bucket").agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t"))
    every = Window.partitionBy(F.lit(0))
    both = both.withColumns({"all_s": F.sum("s").over(every), "all_t": F.sum("t").over(every)})
    ratio = (F.col("t") + 1) * (F.col("all_s") + buckets) / ((F.col("s") + 1) * (F.col("all_t") + buckets))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def weighed(docs: DataFrame, gains: DataFrame, n: int = 1, buckets: int = BUCKETS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_features and weight, the floored mean gain of a document's features (0 without any).

    The gains are a model of ``buckets`` numbers, whatever the corpus; every task holds them.
    """
    model = np.zeros(buckets, np.int64)
    for row in gains.collect():
        model[row["bucket"]] = row["gain"]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            out: list[tuple[int, int, int]] = []
            for body in batch.column("text").to_pylist():
                words = words_of(body) if body else []
                found = ring_buckets(words, n, buckets)
                out.append((len(words), len(found), int(model[found].sum()) // len(found) if found else 0))
            columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def drawn(weights: DataFrame, percent: int, least_words: int, seed: int) -> DataFrame:
    """``weights`` with score and rank; of the documents with ``least_words``, the best ``percent`` of a hundred have a rank.

    Scores are whole numbers of a narrow range, so a histogram of them gives the last score that is drawn; documents
    from there on are numbered along their order in blocks.
    """
    chance = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((chance + 0.5) / 4294967296.0)))
    scored = cut(weights.withColumn("score", (F.col("weight") + noise).cast("long")))
    able = F.col("n_words") >= least_words
    histogram = scored.filter(able).groupBy("score").agg(F.count("*").alias("n"))
    upto = Window.partitionBy(F.lit(0)).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    histogram = histogram.withColumns({"upto": F.sum("n").over(upto), "all": F.sum("n").over(Window.partitionBy(F.lit(0)))})
    take = F.expr(f"(all * {percent}L) div 100L")
    edge = histogram.filter(F.col("upto") - F.col("n") < take).agg(F.min("score").alias("last"), F.max(take).alias("take")).first()
    last, most = (edge["last"], edge["take"]) if edge["last"] is not None else (2**62, 0)
    ahead = F.coalesce(able & (F.col("score") >= last), F.lit(False))
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("_row")]
    ahead_rows = in_blocks(scored.filter(ahead).withColumns({"_row": F.monotonically_increasing_id(), "_all": F.lit(0)}), *order)
    ranked = running(ahead_rows, ["_all"], order, {"rank": F.lit(1)}).withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    names = ["doc_id", "n_features", "weight", "score", "rank", "n_words"]
    rest = scored.filter(~ahead).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*names).unionByName(rest.select(*names))


def resample(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = BUCKETS, percent: int = 10, least_words: int = 20, seed: int = 2024, doc_id: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_features, weight, score, rank and n_words.

    Two scans of the corpus, one for the buckets' gains and one for the weights; texts are never shuffled. Every task
    sends at most ``buckets`` counts, and only numbers of the documents are kept between the steps.

    A null or empty text has no features, weight 0 and no rank; very long texts are counted whole. Equal scores go to
    the smaller doc_id, null ids last, and then to fewer features; rows that repeat are drawn one by one. An empty
    corpus gives no rows, an empty target weighs all buckets alike but for their size; extra columns are ignored.
    """
    gains = bucket_gains(docs, target, n, buckets, text, target_text)
    return drawn(weighed(docs, gains, n, buckets, doc_id, text), percent, least_words, seed)
