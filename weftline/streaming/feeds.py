"""Feeds as a stream of landed responses: conditional fetches, caps and cursors as keyed state.

Whoever fetches lands one row per response; a file source reads each landed file once and goes on after a failure from its
checkpoint. One state per feed decides what a response adds: nothing if it hasn't changed, failures and oversized ones
are counted, and only items that the feed's cursor hasn't passed come out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: A landed response. ``position`` orders the responses of a feed.
RESPONSE = "feed_url string, position long, status int, etag string, last_modified string, body string"
_ITEM = "struct<title:string,link:string,guid:string,pubDate:string,description:string>"
STATE = "etag string, last_modified string, failures int, position long, cursor long, at_cursor array<string>"
OUTPUT = "feed_url string, kind string, position long, failures int, n_items long, n_capped long, n_known long, title string, link string, guid string, published_at timestamp, description string"
NAMES = [c.split()[0] for c in OUTPUT.split(", ")]
MAX_BYTES = 5 << 20
MAX_ITEMS = 500


def landed(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """The stream of responses that land as JSON lines below ``path``."""
    return spark.readStream.schema(RESPONSE).option("maxFilesPerTrigger", files_per_batch).json(path)


def parsed(responses: DataFrame, max_bytes: int = MAX_BYTES, max_items: int = MAX_ITEMS) -> DataFrame:
    """Responses with n_bytes, n_items and at most ``max_items`` items of the RSS document in ``body``; oversized bodies aren't parsed.

    Times are RFC 822 dates; an item without a readable one has none.
    """
    n_bytes = F.octet_length(F.coalesce("body", F.lit("")))
    fits = (F.col("status") == 200) & (n_bytes <= max_bytes)
    document = F.from_xml(F.when(fits, F.col("body")), f"channel struct<item:array<{_ITEM}>>", {"mode": "PERMISSIVE"})
    items = F.coalesce(document["channel"]["item"], F.array().cast(f"array<{_ITEM}>"))
    told = lambda x: F.try_to_timestamp(F.regexp_replace(F.regexp_replace(F.trim(x["pubDate"]), r"^[A-Za-z]{3},\s*", ""), "(GMT|UTC|Z)$", "+0000"), F.lit("d MMM yyyy HH:mm:ss Z"))
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    named = lambda x: F.struct(text(x["title"]).alias("title"), text(x["link"]).alias("link"), F.coalesce(text(x["guid"]), text(x["link"])).alias("guid"), told(x).alias("published_at"), text(x["description"]).alias("description"))
    return responses.select(
        "feed_url", "position", "status", "etag", "last_modified", n_bytes.alias("n_bytes"), (n_bytes > max_bytes).alias("too_large"), F.size(items).cast("long").alias("n_items"),
        F.transform(F.slice(items, 1, max_items), named).alias("items"),
    )


class Feeds(StatefulProcessor):
    """What the responses of a feed add, in their order.

    Rows of kind ``item`` are new items; each response has one row more: ``read``, ``unchanged`` (304, or the validator that is
    known), ``failed`` or ``too_large``, with how many items it had, how many the cap left out, how many were known, and the
    failures in a row. The cursor is the newest time of an item and the guids at it; items without a time are always new.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("feed", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        etag, modified, failures, position, cursor, at_cursor = self.state.get() if self.state.exists() else (None, None, 0, -1, -1, [])
        at_cursor = set(at_cursor or [])
        # A batch holds few responses of a feed, each with capped items.
        responses = sorted((r for frame in rows for r in frame.to_dict("records")), key=lambda r: r["position"])
        for r in responses:
            if r["position"] <= position:
                continue
            position = r["position"]
            same = (isinstance(r["etag"], str) and r["etag"] == etag) or (not isinstance(r["etag"], str) and isinstance(r["last_modified"], str) and r["last_modified"] == modified)
            counts = (0, 0, 0)
            if r["status"] == 304 or (r["status"] == 200 and same):
                kind, failures = "unchanged", 0
            elif r["status"] != 200 or r["too_large"]:
                kind, failures = ("too_large" if r["status"] == 200 else "failed"), failures + 1
            else:
                kind, failures = "read", 0
                etag, modified = (r[c] if isinstance(r[c], str) else None for c in ("etag", "last_modified"))
                items = [i if isinstance(i, dict) else i.asDict() for i in r["items"]]
                times = [None if pd.isna(i["published_at"]) else int(pd.Timestamp(i["published_at"]).value // 1_000_000) for i in items]
                new = [i for i, t in zip(items, times, strict=True) if t is None or t > cursor or (t == cursor and i["guid"] not in at_cursor)]
                counts = (int(r["n_items"]), int(r["n_items"]) - len(items), len(items) - len(new))
                newest = max((t for t in times if t is not None), default=cursor)
                if newest >= cursor:
                    at_cursor = (at_cursor if newest == cursor else set()) | {i["guid"] for i, t in zip(items, times, strict=True) if t == newest and i["guid"]}
                    cursor = newest
                if new:
                    frame = pd.DataFrame(new).assign(feed_url=key[0], kind="item", position=position, failures=None, n_items=None, n_capped=None, n_known=None)
                    yield self._typed(frame)
            row = dict(zip(NAMES, (key[0], kind, position, failures, *counts, None, None, None, pd.NaT, None), strict=True))
            yield self._typed(pd.DataFrame([row]))
        self.state.update((etag, modified, failures, position, cursor, sorted(at_cursor)))

    @staticmethod
    def _typed(frame: pd.DataFrame) -> pd.DataFrame:
        whole = {c: "Int64" for c in ("failures", "n_items", "n_capped", "n_known")}
        return frame[NAMES].astype(whole).assign(published_at=pd.to_datetime(frame["published_at"]))

    def close(self) -> None:
        pass


def feed_items(responses: DataFrame, max_bytes: int = MAX_BYTES, max_items: int = MAX_ITEMS) -> DataFrame:
    """Rows of :class:`Feeds` over a stream of landed responses."""
    return parsed(responses, max_bytes, max_items).groupBy("feed_url").transformWithStateInPandas(Feeds(), OUTPUT, "Append", "None")
