"""Online clustering: an ordered fold per group, in batch and in streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Stories:
    """The stories of one group as they grow: sums of unit vectors and counts."""

    def __init__(self, attach: float, ids: list[int] | None = None, sums: list[list[float]] | None = None, counts: list[int] | None = None):
        self.attach, self.ids, self.counts = attach, ids or [], counts or []
        self.sums = [np.array(s) for s in sums or []]

    def place(self, article: int, vector: np.ndarray) -> tuple[int, float, str]:
        """Attach the article to the most similar story, or found one; the first of equals counts."""
        size = np.linalg.norm(vector)
        if self.ids and size > 0:
            means = np.stack(self.sums)
            sims = means @ vector / (np.maximum(np.linalg.norm(means, axis=1), 1e-300) * size)
            best = int(sims.argmax())
            if sims[best] >= self.attach:
                self.sums[best] = self.sums[best] + vector
                self.counts[best] += 1
                return self.ids[best], float(sims[best]), "attached"
        self.ids.append(article)
        self.sums.append(vector.astype(float))
        self.counts.append(1)
        return article, 0.0, "created"


RESULT = "id long, story_id long, similarity double, status string"


def cluster_in_order(articles: DataFrame, key: str, attach: float) -> DataFrame:
    """(key, id, story_id, similarity, status): articles (key, id, published_at, embedding) in order of time and id.

    Every article meets the stories that those before it left, so the order matters and a group can't be parallel; the
    group, such as a topic or a source and week, bounds what one task folds. State is one vector per story.
    """

    def fold(group: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stories = Stories(attach)
        for rows in batches:
            placed = [(group[0], i, *stories.place(i, np.asarray(v, float))) for i, v in zip(rows["id"], rows["embedding"], strict=True)]
            yield pd.DataFrame(placed, columns=[key, "id", "story_id", "similarity", "status"])

    def whole(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.concat(fold(group, iter([rows.sort_values(["published_at", "id"])])))

    rows = articles.select(key, "id", F.col("published_at").cast("timestamp").alias("published_at"), "embedding").filter("embedding is not null")
    return rows.groupBy(key).applyInPandas(whole, f"{key} string, {RESULT}")
