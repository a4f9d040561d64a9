"""Declarative lists: allow-listed filters, explicit null order, keyset and offset pages."""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def escape_like(term: str) -> str:
    return "".join("\\" + c if c in "\\%_" else c for c in term)


def ilike_any(columns: list[str], term: str) -> Column:
    """The term, taken literally, is in one of the columns, whatever the case."""
    return reduce(Column.__or__, [F.coalesce(F.col(c).ilike(f"%{escape_like(term)}%"), F.lit(False)) for c in columns])


def mixed_search(id_column: str, columns: list[str], term: str) -> Column:
    """A whole number also finds its id."""
    found = ilike_any(columns, term)
    return found | (F.col(id_column) == int(term)) if term.isdigit() else found


@dataclass(frozen=True)
class ListSpec:
    """What a list may filter by, search in and order by. ``order`` is a column, descending with nulls last, then the id."""

    id: str
    order: str
    choices: dict[str, tuple[Any, ...]] = field(default_factory=dict)
    search: tuple[str, ...] = ()
    limit: int = 30
    most: int = 100

    def filters(self, asked: dict[str, Any]) -> Column:
        """Filters for the values asked for; values that aren't a choice are ignored."""
        found = [F.col(c) == v for c, v in asked.items() if v in self.choices.get(c, ())]
        if asked.get("q"):
            found.append(mixed_search(self.id, list(self.search), asked["q"]))
        return reduce(Column.__and__, found, F.lit(True))

    def validate(self, asked: dict[str, Any]) -> None:
        bad = [c for c, v in asked.items() if c != "q" and v not in self.choices.get(c, ())]
        if bad:
            raise ValueError(f"not a choice: {', '.join(sorted(bad))}")

    def rows(self, limit: int | None) -> int:
        return max(1, min(self.most, limit or self.limit))


def encode_cursor(value: Any, row_id: int) -> str:
    return base64.urlsafe_b64encode(json.dumps([value, row_id]).encode()).decode()


def decode_cursor(cursor: str | None) -> tuple[Any, int] | None:
    """Value and id of a cursor; a malformed one stands for the first page."""
    try:
        value, row_id = json.loads(base64.urlsafe_b64decode(cursor or ""))
        return value, int(row_id)
    except (ValueError, TypeError):
        return None


def keyset_page(df: DataFrame, spec: ListSpec, after: tuple[Any, int] | None, limit: int | None = None, probe: bool = True) -> DataFrame:
    """The page after (value, id), one row longer than asked if ``probe``: that row tells that there is more.

    Rows with a null in the order come last, by id; a cursor with a null value is in that part.
    """
    order, row_id = F.col(spec.order), F.col(spec.id)
    if after is not None:
        value, last = after
        tail = order.isNull() & (row_id < last) if value is None else order.isNull()
        df = df.filter(tail if value is None else (order < F.lit(value)) | ((order == F.lit(value)) & (row_id < last)) | tail)
    return df.orderBy(order.desc_nulls_last(), row_id.desc()).limit(spec.rows(limit) + probe)


def numbered_pages(df: DataFrame, spec: ListSpec, size: int) -> DataFrame:
    """Every row with its page, from 1, and the number of pages and rows; for exports of whole lists.

    Places come from counts of ranges of rows, so no task holds the whole list.
    """
    parted = df.repartitionByRange(F.col(spec.order).desc_nulls_last(), F.col(spec.id).desc()).withColumn("_part", F.spark_partition_id())
    from weftline.plans.lineage import cut

    parted = cut(parted)
    counts = parted.groupBy("_part").count()
    before = F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("count")
    counts = counts.select("_part", before.alias("_before"), F.sum("count").over(Window.partitionBy()).alias("total"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(F.col(spec.order).desc_nulls_last(), F.col(spec.id).desc()))
    rows = parted.withColumn("_in", inside).join(F.broadcast(counts), "_part")
    page = F.floor((F.col("_before") + F.col("_in") - 1) / size) + 1
    return rows.withColumns({"page": page, "pages": F.ceil(F.col("total") / size)}).drop("_part", "_in", "_before")


def page_window(current: int, total: int) -> list[int | None]:
    """Page numbers to show, null for a gap."""
    shown = sorted({1, total, *range(max(1, current - 1), min(total, current + 1) + 1)}) if total else []
    out: list[int | None] = []
    for page in shown:
        if out and page - out[-1] > 1:
            out.append(None)
        out.append(page)
    return out


def parse_cursor(cursor: Column) -> Column:
    """Struct of value and id of a ``value::id`` cursor; null, which stands for the first page, if it is malformed."""
    value, row_id = F.regexp_extract(cursor, "^(.+)::(-?[0-9]{1,18})$", 1), F.regexp_extract(cursor, "^(.+)::(-?[0-9]{1,18})$", 2)
    return F.when(row_id != "", F.struct(value.alias("value"), row_id.cast("long").alias("id")))


def shown_pages(current: Column, total: Column) -> Column:
    """Page numbers to show around the current one, with the first and the last; null for a gap."""
    near = F.sequence(F.greatest(current - 1, F.lit(1)), F.least(current + 1, total))
    pages = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(1).cast("long"), total), near)))
    with_gaps = F.flatten(F.transform(pages, lambda p, k: F.when((k > 0) & (p - F.get(pages, F.greatest(k - 1, F.lit(0))) > 1), F.array(F.lit(None).cast("long"), p)).otherwise(F.array(p))))
    return F.when(total > 0, with_gaps).otherwise(F.array().cast("array<bigint>"))
