"""Stories as keyed state of a stream: what attaching articles leaves behind, bands of age by timers, late rows apart.

State is held per story and kept in checkpoints, so a restarted stream goes on where it was. The clock is ``seen_at``, when
an article came in: ages of stories are counted on it, and so is what is too old to be taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

HOUR = 3_600_000
#: Hours up to which a story is young, as in :func:`weftline.operators.scoring.lifecycle`.
AGES = (("emerging", 6), ("growing", 48), ("stable", 120))
STATE = "n long, vectors long, last_ms long, total array<double>, slugs array<string>, band int"
OUTPUT = "story long, kind string, article long, n long, last_at timestamp, lifecycle string, centroid array<double>, slugs array<string>"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NAMES = [name for name, _ in AGES] + ["stale"]
BANDS = [hours * HOUR for _, hours in AGES]


class Stories(StatefulProcessor):
    """Counts, mean, newest time and slugs of every story; a row for every batch that adds to it and every band it enters.

    Kinds of rows: ``story`` after articles came, ``aged`` when a timer moves it to an older band, ``closed`` when it has been
    silent for ``close_hours`` and its state is dropped, and ``late`` for each article that came ``late_hours`` or more after it was published, which changes
    nothing. Times after an article came in are those at which it came.
    """

    def __init__(self, late_hours: float = 96, close_hours: float = 168):
        self.late, self.close_after = int(late_hours * HOUR), int(close_hours * HOUR)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("story", STATE)

    def _row(self, story: int, kind: str, held: tuple | None, article: int | None = None) -> pd.DataFrame:
        n, vectors, last, total, slugs, band = held or (None, 0, None, None, None, None)
        row = (story, kind, article, n, None if last is None else pd.Timestamp(last, unit="ms"), None if band is None else NAMES[band], [x / vectors for x in total] if vectors else None, None if slugs is None else sorted(slugs))
        return pd.DataFrame([row], columns=["story", "kind", "article", "n", "last_at", "lifecycle", "centroid", "slugs"]).astype({"article": "Int64", "n": "Int64"})

    def _band(self, last: int, now: int) -> int:
        return sum(now - last >= b for b in BANDS)

    def _set_timers(self, last: int, now: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        for after in (*BANDS, self.close_after):
            if last + after > now:
                self.handle.registerTimer(last + after)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.state.get() if self.state.exists() else None
        n, vectors, last, total, slugs = (held[0], held[1], held[2], list(held[3] or []), set(held[4] or [])) if held else (0, 0, 0, [], set())
        came, now = False, max(timerValues.getCurrentWatermarkInMs(), 0)
        for frame in rows:
            for article, published, seen, slug, vector in zip(*(frame[c] for c in ("article", "published_at", "seen_at", "slug", "embedding")), strict=True):
                seen_ms = int(seen.value // 1_000_000)
                at = seen_ms if pd.isna(published) else min(int(published.value // 1_000_000), seen_ms)
                if seen_ms - at >= self.late:
                    yield self._row(key[0], "late", None, int(article))
                    continue
                came, n, last = True, n + 1, max(last, at)
                slugs |= {slug} if isinstance(slug, str) else set()
                if vector is not None:
                    total = [a + float(b) for a, b in zip(total, vector, strict=True)] if vectors else [float(x) for x in vector]
                    vectors += 1
        if came:
            state = (n, vectors, last, total, sorted(slugs), self._band(last, now))
            self.state.update(state)
            self._set_timers(last, now)
            yield self._row(key[0], "story", state)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if not self.state.exists():
            return
        now = timerValues.getCurrentWatermarkInMs()
        n, vectors, last, total, slugs, band = self.state.get()
        held = (n, vectors, last, list(total or []), list(slugs or []), self._band(last, now))
        if now - last >= self.close_after:
            self.state.clear()
            yield self._row(key[0], "closed", held)
        elif held[5] != band:
            self.state.update(held)
            yield self._row(key[0], "aged", held)

    def close(self) -> None:
        pass


def story_states(stream: DataFrame, delay: str = "1 hour", late_hours: float = 96, close_hours: float = 168) -> DataFrame:
    """Rows of :class:`Stories` over a stream of links (story, article, published_at, seen_at, slug, embedding).

    ``delay`` is how far apart in time rows may come in. The session's state store must be the one of ``PROVIDER``. A story's
    articles go through one task each batch, a frame at a time; its state is one vector, its slugs and four numbers.
    """
    rows = stream.withWatermark("seen_at", delay).groupBy("story")
    return rows.transformWithStateInPandas(Stories(late_hours, close_hours), OUTPUT, "Update", "EventTime")


def batch_states(links: DataFrame, late_hours: float = 96) -> tuple[DataFrame, DataFrame]:
    """What the stream should hold in the end: (story, n, last_at, centroid, slugs) of all links, and (article) of the late ones."""
    at = F.least(F.coalesce("published_at", "seen_at"), "seen_at")
    rows = links.withColumn("_at", at).withColumn("_late", F.unix_micros("seen_at") - F.unix_micros("_at") >= int(late_hours * HOUR) * 1000)
    kept = rows.filter(~F.col("_late"))
    parts = kept.select("story", F.posexplode("embedding").alias("k", "x")).groupBy("story", "k").agg(F.avg("x").alias("x"))
    means = parts.groupBy("story").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda p: p["x"]).alias("centroid"))
    totals = kept.groupBy("story").agg(F.count("*").alias("n"), F.max("_at").alias("last_at"), F.array_sort(F.collect_set("slug")).alias("slugs"))
    return totals.join(means, "story", "left"), rows.filter("_late").select("article")


def split_sink(path: str):
    """A sink for ``run_once``: late rows and rows of stories go to folders of their own; a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        held.filter("kind = 'late'").select("story", "article").write.mode("overwrite").parquet(f"{path}/late/batch={number}")
        held.filter("kind <> 'late'").drop("article").write.mode("overwrite").parquet(f"{path}/stories/batch={number}")
        held.unpersist()

    return write
