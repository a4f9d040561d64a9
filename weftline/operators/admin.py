"""Corrections: undoing changes, comparing schemas, withdrawing by token, dates that can't be right."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def undo_last(rows: DataFrame, history: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` after the last change of each, from ``history`` (id, field, old_value, changed_at, change), is undone.

    Adds undone, the field that was restored. The column named by the history must be one of ``columns``.
    """
    last = history.groupBy("id").agg(F.max_by(F.struct("field", "old_value"), F.struct("changed_at", "change")).alias("h"))
    joined = rows.join(last, "id", "left")
    restored = {c: F.when(F.col("h.field") == c, F.col("h.old_value").cast(rows.schema[c].dataType)).otherwise(F.col(c)) for c in columns}
    return joined.withColumns(restored).withColumn("undone", F.when(F.col("h.field").isin(columns), F.col("h.field"))).drop("h")


def schema_diff(df: DataFrame, expected: T.StructType) -> dict[str, list[str]]:
    """Columns that are missing, not expected, or of another type."""
    have, want = dict(df.dtypes), {f.name: f.dataType.simpleString() for f in expected}
    return {
        "missing": sorted(want.keys() - have.keys()), "extra": sorted(have.keys() - want.keys()),
        "changed": sorted(c for c in have.keys() & want.keys() if have[c] != want[c]),
    }


def withdraw(subscribers: DataFrame, tokens: DataFrame) -> DataFrame:
    """Subscribers whose token was shown are inactive; showing it again changes nothing."""
    shown = tokens.select("token").distinct().withColumn("_shown", F.lit(True))
    joined = subscribers.join(shown, "token", "left")
    return joined.withColumn("active", F.col("active") & F.col("_shown").isNull()).drop("_shown")


def suspicious(published: Column, found: Column, as_of: Column, days: int = 30) -> Column:
    """Why a date looks wrong: in the future, far from the date that the page states, or missing."""
    apart = F.abs(F.datediff(published, found))
    return F.when(published.isNull(), "missing").when(published > as_of, "future").when(apart > days, "differs").otherwise("ok")
