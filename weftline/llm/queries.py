"""The queries of this package, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from weftline.llm import embeddings, neardup, pieces
from weftline.llm.importance import resample
from weftline.llm.leaks import scan_secrets
from weftline.llm.lengths import length_histogram, suffix_sums
from weftline.llm.licenses import scan_licenses
from weftline.llm.oracles import SQL  # noqa: F401
from weftline.llm.mixing import mix, word_count
from weftline.llm.pseudonyms import pseudonymise
from weftline.llm.quality import quality
from weftline.llm.settings import pseudonym_key, tokenizer
from weftline.llm.sharding import assign_shards
from weftline.llm.trie import narrow_turns, prefix_trie, rebuilt_turns
from weftline.llm.warc import archived_pages, warc_records, write_warc
from weftline.plans.lineage import cut

Query = Callable[[SparkSession, str], DataFrame]


def op1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    encoded = pieces.encode(docs, tokenizer(spark)).drop("text")
    decoded = pieces.decode(encoded, tokenizer(spark))
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), threshold=0.93)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality(docs).select(*names)


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    placed = assign_shards(docs, shards=40, seed=17)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_warc(warc_records(spark.read.parquet(f"{sf_dir}/pages.parquet"), least_bytes=0))
    return archived_pages(spark, path).drop("payload")


def op7_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_sums(length_histogram(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer(spark)))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = cut(docs.select("doc_id", "source", word_count().alias("n_words")))
    mixed = mix(sized, weights=(3, 1, 2), share=1.5, most=2, seed=17, size=F.col("n_words"), favour=lambda n: F.when(n.between(50, 5000), 2).otherwise(1))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("n_blocks")


def op10_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pseudonymise(docs, pseudonym_key(spark)).select("doc_id", "text", "n_private")


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "benchmark"))
    return resample(docs, target, n=1, buckets=10_000, percent=10, least_words=20, seed=2024).drop("n_words")


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = narrow_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return prefix_trie(rebuilt_turns(turns, share=100, kinds=6))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have sources only: a source is an owner, and its documents of one language are a repository."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan_secrets(docs, owner=F.col("source"), repository=F.col("lang"))


QUERIES: dict[str, Query] = {
    "op1_pieces": op1_pieces,
    "op2_embeddings": op2_embeddings,
    "op3_quality": op3_quality,
    "op4_neardup": op4_neardup,
    "op5_sharding": op5_sharding,
    "op6_warc": op6_warc,
    "op7_lengths": op7_lengths,
    "op8_mixing": op8_mixing,
    "op9_licenses": op9_licenses,
    "op10_pseudonyms": op10_pseudonyms,
    "op11_importance": op11_importance,
    "op12_trie": op12_trie,
    "op13_secrets": op13_secrets,
    "pipeline": corpus_pipeline.run,
}
