"""Embedding near-dedup by randomised-rotation binary codes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.plans.graph import connected_components
from weftline.plans.lineage import cut
from weftline.plans.spread import join_spread

#: Standard errors of an estimate below the threshold at which a pair is given up; 4.5 leaves odds of 1 in 10**5.
ERRORS = 4.5
#: Odds that a pair at the threshold shares no cell.
MISSED = 1e-3
#: Vectors of a cell that are compared in one block; larger cells are split into pairs of blocks.
BLOCK = 2048
#: Vectors of one group that a cell may hold on average before cells are made finer.
CELL = 4096


def rotation(dim: int, number: int, seed: int = 20240131) -> np.ndarray:
    """A random rotation, the same everywhere for the same number."""
    g = np.random.default_rng([seed, dim, number]).normal(size=(dim, dim))
    q, r = np.linalg.qr(g)
    return q * np.sign(np.diag(r))


def unit(batch: pa.Array, dim: int) -> np.ndarray:
    x = np.asarray(batch.flatten(), dtype=np.float64).reshape(-1, dim)
    # Scaled first, so that no square over- or underflows.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def shared_cell(dim: int, cosine: float, draws: int = 20_000) -> float:
    """Odds that two unit vectors with this cosine have their largest rotated coordinate, with its sign, in common."""
    rng = np.random.default_rng([dim, int(cosine * 1e6)])
    x, z = rng.normal(size=(2, draws, dim))
    z -= x * ((z * x).sum(1) / (x * x).sum(1))[:, None]
    y = cosine * x / np.linalg.norm(x, axis=1)[:, None] + math.sqrt(1 - cosine**2) * z / np.maximum(np.linalg.norm(z, axis=1), 1e-12)[:, None]
    return float((cells(x)[0] == cells(y)[0]).mean())


def cells(rotated: np.ndarray) -> tuple[np.ndarray, int]:
    """Number of each row's largest coordinate, twice, plus one if it is negative; and how many cells there are."""
    at = np.abs(rotated).argmax(axis=1)
    return 2 * at + (rotated[np.arange(len(at)), at] < 0), 2 * rotated.shape[1]


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Binary codes of unit vectors, and the correction factor of each: its inner product with its code."""
    rotated = x @ rotation(x.shape[1], 0)
    return np.packbits(rotated > 0, axis=1), np.abs(rotated).sum(axis=1) / math.sqrt(x.shape[1])


def estimates(codes: np.ndarray, factors: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased estimates of the inner products of coded vectors with ``y``, and their standard errors by row."""
    dim = y.shape[1]
    signs = np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1
    found = signs @ (y @ rotation(dim, 0)).astype(np.float32).T / math.sqrt(dim)
    error = np.sqrt(np.maximum(1 - factors**2, 0)) / factors / math.sqrt(max(dim - 1, 1))
    return found / factors[:, None], error


def links(codes: np.ndarray, factors: np.ndarray, x: np.ndarray, codes_to: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) with cosine >= threshold: i < codes_to <= j if ``codes_to``, else i < j.

    A pair whose estimate is ``ERRORS`` standard errors below the threshold is given up; all others are computed
    exactly, in double precision.
    """
    left = codes_to or len(x)
    right = x[codes_to:] if codes_to else x
    found, error = estimates(codes[:left], factors[:left], right)
    i, j = np.nonzero(found + ERRORS * error[:, None] >= threshold)
    if codes_to:
        j += codes_to
    else:
        i, j = i[i < j], j[i < j]
    exact = np.concatenate([np.einsum("ij,ij->i", x[i[k : k + 65536]], x[j[k : k + 65536]]) for k in range(0, len(i), 65536)] or [np.empty(0)])
    return i[exact >= threshold], j[exact >= threshold]


def _roots(n: int, i: np.ndarray, j: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Index of the lowest-ranked member of each node's component among ``n`` nodes."""
    label = np.arange(n)
    while True:
        low = np.where(rank[label[i]] < rank[label[j]], label[i], label[j])
        new = label.copy()
        order = np.argsort(-rank[low], kind="stable")
        for ends in (i, j):
            at, by = ends[order], low[order]
            better = rank[by] < rank[new[at]]
            new[at[better]] = by[better]
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _cell_rows(depth: dict[int, int], tables: dict[int, int], wide: bool):
    """Per vector and table one row: the cell and, if ``wide``, all that comparing takes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                x = unit(part.column("embedding"), dim)
                count = tables[dim]
                found = np.empty((len(x), count), np.int64)
                for t in range(count):
                    found[:, t] = 0
                    for level in range(depth[dim]):
                        cell, size = cells(x @ rotation(dim, 1 + t * depth[dim] + level))
                        found[:, t] = found[:, t] * size + cell
                n = len(x)
                columns = {"grp": part.column("grp"), "dim": part.column("dim")}
                if wide:
                    codes, factors = encode(x)
                    all_cells = pa.array([row.tobytes() for row in found], pa.binary())
                    columns |= {
                        "rep": part.column("rep"), "weight": part.column("weight"), "embedding": part.column("embedding"),
                        "code": pa.array([c.tobytes() for c in codes], pa.binary()), "factor": pa.array(factors), "cells": all_cells,
                    }
                for t in range(count):
                    out = columns | {"tab": pa.array(np.full(n, t, np.int32)), "cell": pa.array(found[:, t])}
                    yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return rows


KEYS = ["grp", "dim", "tab", "cell"]


def _compare(threshold: float):
    """Rows sorted by cell and pair of blocks -> (rep, links, root), one row per vector with a link in its cell."""

    def one(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        dim, tab = rows.column("dim")[0].as_py(), rows.column("tab")[0].as_py()
        x = unit(rows.column("embedding").combine_chunks(), dim)
        codes = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(len(x), -1)
        side = rows.column("side").to_numpy()
        i, j = links(codes, rows.column("factor").to_numpy(), x, int((side == 0).sum()) if side.any() else 0, threshold)
        if not len(i):
            return None
        rep, weight = rows.column("rep").to_numpy(), rows.column("weight").to_numpy()
        cell = np.frombuffer(b"".join(rows.column("cells").to_pylist()), np.int64).reshape(len(x), -1)
        # A pair that met in an earlier table has been counted there.
        first = ~(cell[i, :tab] == cell[j, :tab]).any(axis=1)
        count = np.bincount(i[first], weight[j[first]], len(x)) + np.bincount(j[first], weight[i[first]], len(x))
        root = rep[_roots(len(x), i, j, np.argsort(np.argsort(rep)))]
        linked = np.unique(np.concatenate([i, j]))
        return pa.RecordBatch.from_arrays([pa.array(rep[linked]), pa.array(count[linked].astype(np.int64)), pa.array(root[linked])], names=["rep", "links", "root"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key_of_held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(*(batch.column(c).to_pylist() for c in [*KEYS, "low", "high"]), strict=True))
            starts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            for at, end in zip(starts, starts[1:], strict=False):
                if keys[at] != key_of_held:
                    if held and sum(b.num_rows for b in held) > 1 and (out := one(pa.Table.from_batches(held))) is not None:
                        yield out
                    held, key_of_held = [], keys[at]
                held.append(batch.slice(at, end - at))
        if held and sum(b.num_rows for b in held) > 1 and (out := one(pa.Table.from_batches(held))) is not None:
            yield out

    return compare


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, vec_id: str = "vec_id", embedding: str = "embedding", group: str = "label") -> DataFrame:
    """Per row of ``vectors``: vec_id, n_links, component_id, kept. Vectors of one group with cosine >= ``threshold`` are linked.

    Vectors that are equal in a group are one class, compared once. The largest coordinates of randomly rotated
    vectors name cells, in so many tables that a pair at the threshold shares none with odds of ``MISSED`` only; in a
    cell, binary codes with their correction factors estimate all inner products, and pairs whose confidence bound
    reaches the threshold are computed exactly. A cell beyond ``BLOCK`` vectors is dealt out as pairs of blocks.
    Cells grow finer with the largest group, so the work does not grow with its square.

    Vectors link with nothing if they or their group are null, if a component is null or not finite, or if all are 0.
    Vectors of different lengths never link. Rows that repeat an id and its vector are vectors that link; different
    vectors under one id share their links. A row without an id has a null component and is kept, and vectors that
    stand under no id at all link with nothing. An empty table gives no rows; extra columns are ignored.
    """
    values = F.col(embedding)
    usable = (
        F.col(group).isNotNull() & (F.size(values) > 0)
        & F.forall(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(values, lambda v: v != 0)
    )
    rows = vectors.select(
        F.col(vec_id).alias("vec_id"), F.coalesce(usable, F.lit(False)).alias("usable"), F.col(group).cast("string").alias("grp"), values.alias("embedding"),
        F.xxhash64(values).alias("h1"), F.xxhash64(F.lit(1), values).alias("h2"),
    )
    classes = rows.filter("usable").groupBy("grp", "h1", "h2").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("embedding").alias("embedding")
    )
    classes = cut(classes.select("grp", "h1", "h2", "rep", "weight", F.size("embedding").alias("dim"), "embedding").filter("rep is not null"))
    edges, counts = _linked(classes, threshold)
    component = connected_components(edges, "rep", "root")
    found = (
        classes.select("grp", "h1", "h2", "rep", "weight")
        .join(counts, "rep", "left")
        .join(component.withColumnRenamed("node", "rep"), "rep", "left")
        .select("grp", "h1", "h2", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("first"))
    )
    # Null keys match nothing; the rows of one class are spread over tasks.
    narrow = cut(rows.select("vec_id", F.when(F.col("usable"), F.col("grp")).alias("grp"), "h1", "h2"))
    joined = join_spread(narrow, found, ["grp", "h1", "h2"], F.coalesce("vec_id", F.lit(0))).select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("vec_id").isNotNull(), F.coalesce("first", "vec_id")).alias("component_id")
    )
    return joined.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _linked(classes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Edges (rep, root) that span all components, and (rep, links) counts, of the classes."""
    sizes = classes.groupBy("grp", "dim").count().groupBy("dim").agg(F.max("count").alias("n")).collect()  # one row per vector length
    depth, tables = {}, {}
    for dim, n in ((r["dim"], r["n"]) for r in sizes):
        depth[dim] = max(1, math.ceil(math.log(max(n / CELL, 1)) / math.log(2 * dim)) if dim > 1 else 1)
        share = min(shared_cell(dim, threshold) ** depth[dim], 1 - 1e-9)
        tables[dim] = max(1, math.ceil(math.log(MISSED) / math.log(1 - share)))
    narrow = classes.mapInArrow(_cell_rows(depth, tables, wide=False), "grp string, dim int, tab int, cell long")
    large = narrow.groupBy(*KEYS).count().filter(F.col("count") > BLOCK)
    large = cut(large.select(*KEYS, F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")))
    kind = classes.schema["embedding"].dataType.simpleString()
    wide = f"grp string, dim int, rep long, weight long, embedding {kind}, code binary, factor double, cells binary, tab int, cell long"
    rows = classes.mapInArrow(_cell_rows(depth, tables, wide=True), wide)
    # Each block meets every other and itself; ``side`` tells the lower block of a pair from the higher.
    blocks = F.coalesce("blocks", F.lit(1))
    rows = rows.join(large, KEYS, "left").withColumns({"blocks": blocks, "own": F.pmod(F.xxhash64("rep"), blocks).cast("int")})
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other"), "side": (F.col("own") > F.col("other")).cast("int")})
    by: list[Column] = [F.col(c) for c in [*KEYS, "low", "high"]]
    rows = rows.drop("blocks", "own", "other").repartition(*by).sortWithinPartitions(*by, "side")
    found = cut(rows.mapInArrow(_compare(threshold), "rep long, links long, root long"))
    return found.select("rep", "root"), found.groupBy("rep").agg(F.sum("links").alias("links"))
