"""Categories of failures and what they lead to."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Category, pattern of the message, hours to wait; null hours mean never again. First match counts.
CATEGORIES = (
    ("infra_auth", r"invalid api key|401|unauthorized", 1),
    ("budget_exceeded", r"exceeded your current quota|insufficient_quota|budget exceeded", 24),
    ("rate_limit", r"429|rate limit", 24),
    ("token_limit", r"maximum context|token", None),
    ("network_timeout", r"timeout|econnreset|socket", 12),
    ("json_parse", r"json parse failed|valid json|json|schema", 12),
    ("content_policy", r"content policy|content_filter", None),
    ("invalid_request", r"400|invalid request", None),
)


def error_category(message: Column) -> Column:
    """category, cooldown_hours and permanent of an error message."""
    low = F.lower(message)

    def outcome(name: str, hours: int | None) -> Column:
        return F.struct(F.lit(name).alias("category"), F.lit(hours).cast("int").alias("cooldown_hours"), F.lit(hours is None).alias("permanent"))

    return F.coalesce(*(F.when(low.rlike(p), outcome(n, h)) for n, p, h in CATEGORIES), outcome("unknown", 12))


def failure_state(failures: Column, failed: Column, limit: int = 5) -> Column:
    """Failures add up to a permanent failure at ``limit``; a budget error should be passed as not failed."""
    return F.when(failures + F.when(failed, 1).otherwise(0) >= limit, "permanent_failure").otherwise("retry")
