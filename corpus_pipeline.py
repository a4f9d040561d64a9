"""From raw documents to token ids: quality, near-duplicates, personal data, mixture, pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import mixing, neardup, pieces, pseudonyms, quality
from weftline.llm.settings import pseudonym_key, tokenizer
from weftline.plans.lineage import counted, cut
from weftline.plans.spread import join_spread

#: Columns of documents, which all stages but the last return.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null, empty and very short texts go; an unknown or null language is held against all references; rows that repeat
    stay or go together; an empty table gives none; columns beyond those of documents are dropped, whatever their names.
    """
    return quality.quality(docs.select(COLUMNS)).filter("kept").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest id.

    Of rows with one id and text the least stays, by the other columns in order, nulls first; of different texts under
    the smallest id, that with the least digest. Rows without an id or a text are each their own document and stay.
    Texts without words are one with equal texts only; an empty table gives none; further columns are dropped.
    """
    found, tasks = counted(neardup.near_duplicates(docs))
    named = found.coalesce(tasks).filter("doc_id is not null and text_md5 is not null")
    first = named.filter("kept").groupBy("class_id").agg(F.min("text_md5").alias("_first")).coalesce(tasks)
    dropped = join_spread(named, first, ["class_id"], "doc_id", "inner", tasks).filter(~F.col("kept") | (F.col("text_md5") != F.col("_first")))
    dropped = dropped.select("doc_id", F.col("text_md5").alias("_md5")).distinct()
    others = [c for c in COLUMNS if c not in ("doc_id", "text")]
    # Rows that repeat are one document; they meet where they stand, before their texts are sent out.
    named = docs.filter("doc_id is not null and text is not null").select(*COLUMNS, F.md5("text").alias("_md5"))
    least = named.groupBy("doc_id", "_md5").agg(F.first("text").alias("text"), F.min(F.struct(*others)).alias("_least"))
    left = least.join(dropped, ["doc_id", "_md5"], "left_anti")
    left = left.select("doc_id", "text", *(F.col(f"_least.{c}").alias(c) for c in others)).select(COLUMNS)
    return left.unionByName(docs.filter("doc_id is null or text is null").select(COLUMNS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms for personal data, and n_chars of the new texts.

    A null text stays null, with a null n_chars; texts without such data stay as they are; rows that repeat get equal
    results; an empty table gives none; further columns are dropped. The key is the session's, see ``pseudonym_key``.
    """
    found = pseudonyms.pseudonymise(docs.select(COLUMNS), pseudonym_key(spark))
    return found.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them, at most twice; so all words together are as many as before.

    Null sources are a source of their own, null and empty texts have no words and are taken as the order has it; rows
    that repeat are taken one by one; an empty table gives none; further columns are dropped.
    """
    mixed = mixing.mix(docs.select(COLUMNS), weights=(3, 1, 2), share=1.0, most=2, seed=17).filter("copies > 0")
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies"))).select(COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, and the digest of what they decode to: doc_id, source, ids, n_tokens, ids_sha256, decoded_sha256.

    A null text is encoded as an empty one, to the begin and end ids alone; rows that repeat get equal results; an empty
    table gives none.
    """
    encoded = pieces.encode(docs.select("doc_id", "source", "text"), tokenizer(spark)).drop("text")
    decoded = pieces.decode(encoded.withColumn("token_ids", F.col("ids")), tokenizer(spark))
    digest = F.sha2(F.encode("decoded", "UTF-8"), 256)
    return decoded.select("doc_id", "source", F.col("token_ids").alias("ids"), "n_tokens", "ids_sha256", digest.alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("personal data", personal_data),
    ("source mixture", source_mixture),
    ("token ids", token_ids),
]

#: SQL has neither alignments nor piece merges; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if number == 0 else cut(docs), sf_dir)
    return docs
