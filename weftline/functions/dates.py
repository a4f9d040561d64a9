"""Labels of times, levels and costs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def time_ago(now: Column, at: Column) -> Column:
    """Minutes, hours or days since, in whole units."""
    seconds = F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / 1_000_000)

    def units(size: int, letter: str) -> Column:
        return F.concat(F.floor(seconds / size).cast("string"), F.lit(f"{letter} ago"))

    return F.when(seconds < 60, "just now").when(seconds < 3600, units(60, "m")).when(seconds < 86400, units(3600, "h")).otherwise(units(86400, "d"))


def alarm_level(level: Column, severity: Column, levels: dict[str, int], default: int = 2) -> Column:
    """The level if there is one (0 is none), else that of the severity."""
    found = F.create_map(*(F.lit(x) for kv in levels.items() for x in kv))
    return F.coalesce(F.when(level > 0, level.cast("int")), F.try_element_at(found, severity), F.lit(default)).cast("int")


def call_cost(prompt: Column, completion: Column, per_prompt: float = 0.0025, per_completion: float = 0.01) -> Column:
    """Cost of a call by its tokens, at prices per thousand."""
    return prompt / 1000 * per_prompt + completion / 1000 * per_completion


def backoff_minutes(attempts: Column) -> Column:
    return F.pow(F.lit(2), F.least(attempts, F.lit(10))).cast("int")


def rel_date(now: Column, at: Column) -> Column:
    """today, yesterday, or days, weeks, months or years ago in rounded units."""
    days = F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / 86_400_000_000 + 0.5)

    def units(size: int, letters: str) -> Column:
        return F.concat(F.floor(days / size + 0.5).cast("string"), F.lit(f"{letters} ago"))

    return F.when(days == 0, "today").when(days == 1, "yesterday").when(days < 7, units(1, "d")).when(days < 30, units(7, "w")).when(days < 365, units(30, "mo")).otherwise(units(365, "y"))
