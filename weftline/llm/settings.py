"""What a cluster sets for its own runs."""

from __future__ import annotations

import secrets

from pyspark.sql import SparkSession

MODEL = "spark.weftline.pieces.model"
#: Spark redacts settings with "secret" in their names.
KEY = "spark.weftline.pseudonyms.secret"


def tokenizer(spark: SparkSession) -> str:
    """Path of the SentencePiece model, the same on all executors; by default the installed public one."""
    import public_tokenizers

    return spark.conf.get(MODEL, None) or public_tokenizers.path("piece_bpe_32k.model")


def pseudonym_key(spark: SparkSession) -> str:
    """The key of the pseudonyms. Set it to link values across runs; where it is unset, the session draws one of its own
    that is never stored, so nobody can undo the pseudonyms."""
    if not spark.conf.get(KEY, None):
        spark.conf.set(KEY, secrets.token_hex(32))
    return spark.conf.get(KEY)
