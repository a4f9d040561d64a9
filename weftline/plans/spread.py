"""Joins of rows with facts about their keys where one key may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tasks among which the rows of one key may be dealt.
SALTS = 256


def join_spread(rows: DataFrame, facts: DataFrame, keys: list[str], by: Column | str, how: str = "left", tasks: int | None = None) -> DataFrame:
    """``rows`` joined with ``facts``, which has one row per key; the rows of a key are spread by a hash of ``by``.

    A fact goes to those slices only in which its key has rows, so no more facts are sent out than there are rows, and a
    key takes at most ``SALTS`` of them. Null keys match nothing. ``tasks`` are what the rows are worth, see ``counted``;
    by default there are as many as the shuffle has partitions.
    """
    dealt_to = (lambda df: df.coalesce(tasks)) if tasks else (lambda df: df)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    dealt = dealt_to(dealt_to(salted.select(*keys, "_salt").distinct()).join(facts, keys))
    return dealt_to(salted.join(dealt, [*keys, "_salt"], how)).drop("_salt")
