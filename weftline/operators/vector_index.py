"""Index of vectors: an inverted file of cells, probed by similarity, with exact cosines inside.

Cells belong to coarse centroids, which are fitted on a bounded sample; every vector lies in the cell of the centroid
nearest to it. A search looks into the cells nearest to the query only. How many that must be depends on how clustered
the vectors are, so the fit measures it: the fewest cells with which held-out vectors of the sample find the wanted
share of their true neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.plans.lineage import cut

#: Vectors of which the centroids are fitted and the probes measured, at most; those whose ids have the smallest hashes.
SAMPLE = 32_768
#: Vectors per cell that the fit aims at; fewer vectors than one cell holds are searched exactly.
CELL = 128
MOST_CELLS = 16_384
#: Of the sample's vectors that are asked for their neighbours when probes are measured.
ASKED = 512
ROUNDS = 8
#: Vectors, and queries, that one task compares at once.
BLOCK = 4096
ROWS = 1024


@dataclass(frozen=True)
class Cells:
    """The fitted model: unit centroids by row, how many cells a search probes, and the recall that the sample showed for it."""

    centroids: np.ndarray
    probes: int
    recall: float

    @property
    def parts(self) -> int:
        return len(self.centroids)


def unit_rows(vectors: list, dims: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of the usable vectors, and these as rows of length 1. Null, zero and non-finite ones, and those of other dimensions, aren't usable."""
    places = [k for k, v in enumerate(vectors) if v is not None and len(v) and (dims is None or len(v) == dims) and None not in v]
    if not places:
        return np.empty(0, int), np.empty((0, dims or 0))
    width = len(vectors[places[0]])
    places = [k for k in places if len(vectors[k]) == width]
    rows = np.array([vectors[k] for k in places], float)
    with np.errstate(over="ignore", invalid="ignore"):
        size = np.sqrt((rows * rows).sum(axis=1))
    good = np.isfinite(size) & (size > 0)
    return np.array(places)[good], rows[good] / size[good, None]


def fit_cells(vectors: DataFrame, key: str, vector: str, k: int = 10, recall: float = 0.95, cells: int | None = None, sample: int = SAMPLE) -> Cells:
    """Fit the cells of ``vectors`` on at most ``sample`` of them.

    The sample's neighbours are farther off than those among all vectors, so more cells are probed than it would take:
    the measured recall is a lower bound in practice. The sample is chosen by the hash of the key, so runs agree.
    """
    n = vectors.count()
    held = vectors.filter(F.col(vector).isNotNull()).orderBy(F.xxhash64(key), key).limit(sample).select(vector).collect()
    rows = unit_rows([r[0] for r in held])[1]
    count = min(cells or -(-n // CELL), MOST_CELLS, max(len(rows), 1))
    if count <= 1 or not len(rows):
        return Cells(rows[:1] if len(rows) else np.zeros((1, 1)), 1, 1.0)
    centroids = rows[np.random.default_rng(17).choice(len(rows), count, replace=False)]
    for _ in range(ROUNDS):
        own = _nearest_cells(rows, centroids, 1)[:, 0]
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, rows)
        size = np.linalg.norm(sums, axis=1)
        centroids = np.where(size[:, None] > 0, sums / np.maximum(size, 1e-300)[:, None], centroids)
    own = _nearest_cells(rows, centroids, 1)[:, 0]
    asked = rows[: min(ASKED, len(rows) // 2)]
    sims = asked @ rows.T
    np.fill_diagonal(sims, -2)
    k = min(k, len(rows) - 1)
    true = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    place = np.empty((len(asked), count), int)
    np.put_along_axis(place, np.argsort(-(asked @ centroids.T), axis=1), np.arange(count)[None, :], axis=1)
    needed = np.sort(np.take_along_axis(place, own[true], axis=1).ravel())
    at = min(int(np.ceil(recall * len(needed))), len(needed)) - 1
    probes = int(needed[max(at, 0)]) + 1
    return Cells(centroids, probes, float((needed < probes).mean()))


def _nearest_cells(rows: np.ndarray, centroids: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` cells nearest to each row, the nearest first."""
    out = []
    for at in range(0, len(rows), ROWS):
        sims = rows[at : at + ROWS] @ centroids.T
        first = np.argpartition(-sims, most - 1, axis=1)[:, :most] if most < len(centroids) else np.broadcast_to(np.arange(len(centroids)), sims.shape)
        order = np.argsort(-np.take_along_axis(sims, first, axis=1), axis=1, kind="stable")
        out.append(np.take_along_axis(first, order, axis=1))
    return np.concatenate(out) if out else np.empty((0, most), int)


def in_cells(vectors: DataFrame, model: Cells, key: str, vector: str, most: int = 1) -> DataFrame:
    """(key, v, cells): usable vectors at length 1 with the ``most`` cells nearest to them; others are left out."""
    dims = model.centroids.shape[1]
    most = min(most, model.parts)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            places, rows = unit_rows(batch.column("v").to_pylist(), dims)
            if len(places):
                cells = _nearest_cells(rows, model.centroids, most)
                columns = [batch.column("key").take(pa.array(places)), pa.array(list(rows), pa.list_(pa.float64())), pa.array(cells.tolist(), pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "v", "cells"])

    kind = vectors.schema[key].dataType.simpleString()
    return vectors.select(F.col(key).alias("key"), F.col(vector).alias("v")).mapInArrow(place, f"key {kind}, v array<double>, cells array<int>")


def indexed(vectors: DataFrame, model: Cells, key: str, vector: str) -> DataFrame:
    """(key, v, cell) of all usable vectors: the index's rows."""
    return in_cells(vectors, model, key, vector).select("key", "v", F.get("cells", F.lit(0)).alias("cell"))


def _top(k: int, kind: pa.DataType, asked: pa.DataType):
    """Rows sorted by group and side -> (query, key, sim): the ``k`` best of every query in its group, of the cells that it probes."""

    def best(rows: list[dict]) -> Iterator[tuple]:
        asks = [r for r in rows if r["side"] == 0]
        held = rows[len(asks) :]
        if not asks or not held:
            return
        queries, vectors = np.array([r["v"] for r in asks]), np.array([r["v"] for r in held])
        probing: dict[int, list[int]] = {}
        for q, r in enumerate(asks):
            for cell in r["cells"]:
                probing.setdefault(cell, []).append(q)
        members: dict[int, list[int]] = {}
        for m, r in enumerate(held):
            members.setdefault(r["cells"][0], []).append(m)
        found: dict[int, list[tuple[float, int]]] = {}
        for cell, own in members.items():
            if cell in probing:
                sims = queries[probing[cell]] @ vectors[own].T
                take = min(k, len(own))
                for q, line in zip(probing[cell], sims, strict=True):
                    # All that equal the last one stay, so ties are settled by the keys later.
                    least = np.partition(line, -take)[-take]
                    found.setdefault(q, []).extend((float(line[m]), own[m]) for m in np.flatnonzero(line >= least - 1e-12))
        for q, pairs in found.items():
            pairs.sort(key=lambda p: -p[0])
            least = pairs[min(k, len(pairs)) - 1][0] - 1e-12
            yield from ((asks[q]["query"], held[m]["key"], sim) for sim, m in pairs if sim >= least)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        last = None

        def done() -> Iterator[pa.RecordBatch]:
            if found := list(best(held)):
                columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), (asked, kind, pa.float64()), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["query", "key", "sim"])

        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            for row in batch.to_pylist():
                group = tuple(row[c] for c in GROUP)
                if group != last:
                    yield from done()
                    held, last = [], group
                held.append(row)
        yield from done()

    return compare


GROUP = ["part", "rows", "queries"]


def search(index: DataFrame, queries: DataFrame, model: Cells, k: int, key: str = "query", vector: str = "v") -> DataFrame:
    """(query, key, n, sim, margin): the ``k`` rows of the index most similar to each query among the cells that it probes.

    Equal similarities, to nine places, go to the smaller key; margin is the lead over the next one. Cells are packed
    into parts of about ``BLOCK`` rows. A part with more rows, or more queries, than a block is cut into slices of both,
    and each slice of rows meets each of queries; so neither a crowded cell nor a popular one is gathered in one task.
    A query is sent once to every part that holds cells it probes. Counts per part are as many as the cells at most.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    total = max(index.count(), 1)
    parts = max(1, min(-(-total // BLOCK), model.parts))
    per = -(-model.parts // parts)
    asks = in_cells(queries, model, key, vector, model.probes).withColumnRenamed("key", "query")
    asks = asks.withColumn("part", F.explode(F.array_distinct(F.transform("cells", lambda c: F.floor(c / per).cast("int")))))
    held = index.withColumn("part", F.floor(F.col("cell") / per).cast("int"))
    counts = held.groupBy("part").agg(F.count("*").alias("n")).join(asks.groupBy("part").agg(F.count("*").alias("q")), "part")
    plan = F.broadcast(counts.select("part", F.ceil(F.col("n") / BLOCK).cast("int").alias("_r"), F.ceil(F.col("q") / BLOCK).cast("int").alias("_q")))
    kinds = {name: df.schema[name].dataType for df, name in ((index, "key"), (asks, "query"))}
    none = {name: F.lit(None).cast(kind) for name, kind in kinds.items()}

    def upto(n: str):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    left = asks.join(plan, "part").withColumn("queries", F.pmod(F.xxhash64("query"), F.col("_q")).cast("int")).withColumn("rows", upto("_r"))
    right = held.join(plan, "part").withColumn("rows", F.pmod(F.xxhash64("key"), F.col("_r")).cast("int")).withColumn("queries", upto("_q"))
    left = left.select(*GROUP, F.lit(0).alias("side"), "query", none["key"].alias("key"), "v", "cells")
    right = right.select(*GROUP, F.lit(1).alias("side"), none["query"].alias("query"), "key", "v", F.array("cell").alias("cells"))
    met = left.unionByName(right).repartition(*GROUP).sortWithinPartitions(*GROUP, "side")
    shape = f"query {kinds['query'].simpleString()}, key {kinds['key'].simpleString()}, sim double"
    best = met.mapInArrow(_top(k + 1, to_arrow_type(kinds["key"]), to_arrow_type(kinds["query"])), shape).withColumn("sim", F.round("sim", 9))
    order = Window.partitionBy("query").orderBy(F.col("sim").desc(), "key")
    ranked = best.withColumns({"n": F.row_number().over(order), "margin": F.col("sim") - F.lead("sim").over(order)})
    return ranked.filter(F.col("n") <= k).select("query", "key", "n", "sim", "margin")


def near(articles: DataFrame, stories: DataFrame, k: int, article: str = "article", story: str = "story", vector: str = "embedding", centroid: str = "centroid", recall: float = 0.95) -> DataFrame:
    """(article, story, n, sim, margin) of about the ``k`` stories most similar to each article, through an index of the stories.

    Stories that one cell holds are searched exactly. Missing or zero vectors are near nothing.
    """
    model = fit_cells(stories, story, centroid, recall=recall)
    found = search(cut(indexed(stories, model, story, centroid)), articles, model, k, article, vector)
    return found.select(F.col("query").alias("article"), F.col("key").alias("story"), "n", "sim", "margin")


def write_index(rows: DataFrame, model: Cells, path: str) -> None:
    """Store an index: its centroids, and its rows in folders of cells."""
    spark = rows.sparkSession
    cells = [(k, [float(x) for x in c], model.probes, model.recall) for k, c in enumerate(model.centroids)]
    spark.createDataFrame(cells, "cell int, centroid array<double>, probes int, recall double").coalesce(1).write.parquet(f"{path}/cells")
    _add(rows, path, 0)


def _add(rows: DataFrame, path: str, batch: int) -> None:
    placed = rows.withColumns({"batch": F.lit(batch), "folder": F.floor(F.col("cell") / 64).cast("int")})
    placed.repartition("folder", F.pmod(F.xxhash64("key"), F.lit(16))).write.mode("append").partitionBy("folder").parquet(f"{path}/rows")


def update_index(spark: SparkSession, path: str, vectors: DataFrame, key: str, vector: str, batch: int) -> None:
    """Add a batch of new or moved vectors to a stored index; of a key, the latest batch counts. Centroids stay as they are."""
    _add(indexed(vectors, read_cells(spark, path), key, vector), path, batch)


def read_cells(spark: SparkSession, path: str) -> Cells:
    rows = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
    return Cells(np.array([r["centroid"] for r in rows]), rows[0]["probes"], rows[0]["recall"])


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(key, v, cell) of a stored index, each key as its latest batch has it."""
    rows = spark.read.parquet(f"{path}/rows")
    return rows.groupBy("key").agg(F.max(F.struct("batch", "cell", "v")).alias("r")).select("key", "r.v", "r.cell")
