"""The index of vectors against brute force."""

import math

import numpy as np
import pytest

from weftline.operators import vector_index as V

SCHEMA = "id long, v array<float>, n string, sim string, cell string, part string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(np.float32(x)) if x is not None else None for x in v], "x", "x", "x", "x") for i, v in rows], SCHEMA)


def brute(rows, queries, k):
    """Neighbours with similarities of all queries, exact, ties to the smaller id."""
    usable = [(i, np.asarray(v, np.float32).astype(float)) for i, v in rows if v is not None and None not in v and len(v) and np.isfinite(v).all() and np.any(v)]
    ids, m = np.array([i for i, _ in usable]), np.array([v / np.linalg.norm(v) for _, v in usable])
    out = {}
    for q in queries:
        at = int(np.flatnonzero(ids == q)[0])
        sims = np.round(m @ m[at], 9)
        out[q] = [(int(ids[j]), sims[j]) for j in np.lexsort((ids, -sims))[:k]]
    return out


def searched(spark, rows, k, monkeypatch, block=4096, cells=None):
    monkeypatch.setattr(V, "BLOCK", block)
    df = frame(spark, rows).repartition(3)
    model = V.fit_cells(df, "id", "v", k=k, cells=cells)
    found = V.search(V.cut(V.indexed(df, model, "id", "v")), df.filter("id % 5 = 0"), model, k, "id", "v").collect()
    out = {}
    for r in sorted(found, key=lambda r: (r["query"], r["n"])):
        out.setdefault(r["query"], []).append((r["key"], r["sim"], r["margin"]))
    return model, out


def clustered(n, dim=24, centres=40, seed=3):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dim))
    return [(i, c[i % centres] + rng.normal(size=dim) * 0.25) for i in range(n)]


@pytest.mark.parametrize("kind", ["clustered", "scattered"])
def test_recall_reaches_nine_in_ten(spark, monkeypatch, kind):
    rng = np.random.default_rng(8)
    rows = clustered(3000) if kind == "clustered" else [(i, rng.normal(size=24)) for i in range(3000)]
    model, found = searched(spark, rows, 10, monkeypatch)
    assert model.parts > 20 and model.probes < (model.parts / 4 if kind == "clustered" else model.parts)
    want = brute(rows, found, 10)
    assert len(found) == 600
    hit = sum(len({i for i, _ in want[q]} & {i for i, *_ in found[q]}) for q in found)
    assert hit >= 0.9 * 10 * len(found)
    for own in found.values():
        sims = [s for _, s, _ in own]
        assert sims == sorted(sims, reverse=True)


@pytest.mark.parametrize("block", [4096, 40])
def test_one_cell_is_exact_with_ties_and_odd_vectors(spark, monkeypatch, block):
    """A third of all vectors are equal; slices of a crowded part meet all queries."""
    rng = np.random.default_rng(9)
    hot = rng.normal(size=8)
    rows = [(i, hot if i % 3 == 0 else rng.normal(size=8)) for i in range(240)]
    odd = [(1000, None), (1005, [0.0] * 8), (1010, [math.nan] * 8), (1015, [1.0, None] * 4), (1020, [1.0, 2.0]), (1025, [])]
    model, found = searched(spark, rows + odd, 5, monkeypatch, block=block, cells=1)
    assert (model.parts, model.probes) == (1, 1) and set(found) == set(range(0, 240, 5))
    want = brute(rows, found, 6)
    for q, own in found.items():
        assert [(i, s) for i, s, _ in own] == pytest.approx([pytest.approx(x, abs=1e-8) for x in want[q][:5]])
        for (_, s, margin), (_, following) in zip(own, want[q][1:], strict=True):
            assert margin == pytest.approx(s - following, abs=2e-9)


def test_hot_cells_are_sliced(spark, monkeypatch):
    rng = np.random.default_rng(10)
    hot = rng.normal(size=16)
    rows = [(i, hot + rng.normal(size=16) * (0.01 if i % 3 else 3)) for i in range(900)]
    model, found = searched(spark, rows, 10, monkeypatch, block=50, cells=12)
    want = brute(rows, found, 10)
    assert sum(len({i for i, _ in want[q]} & {i for i, *_ in found[q]}) for q in found) >= 9 * len(found)


def test_stored_index_takes_batches(spark, tmp_path):
    rows = clustered(600)
    path = str(tmp_path / "index")
    df = frame(spark, rows)
    model = V.fit_cells(df, "id", "v", k=5)
    V.write_index(V.indexed(df, model, "id", "v"), model, path)
    moved = [(0, rows[1][1]), (9000, rows[2][1] * 2)]
    V.update_index(spark, path, frame(spark, moved), "id", "v", batch=1)
    index, again = V.read_index(spark, path), V.read_cells(spark, path)
    assert (again.probes, again.parts) == (model.probes, model.parts) and np.allclose(again.centroids, model.centroids)
    assert index.count() == 601
    found = {(r["query"], r["n"]): r for r in V.search(index, frame(spark, [rows[1], rows[2]]), again, 2, "id", "v").collect()}
    assert (found[1, 1]["key"], found[1, 2]["key"]) == (0, 1) and (found[2, 1]["key"], found[2, 2]["key"]) == (2, 9000)


def test_empty_tables(spark):
    none, some = frame(spark, []), frame(spark, clustered(10))
    model = V.fit_cells(none, "id", "v")
    assert V.search(V.indexed(none, model, "id", "v"), some, model, 3, "id", "v").count() == 0
    model = V.fit_cells(some, "id", "v")
    assert V.search(V.indexed(some, model, "id", "v"), none, model, 3, "id", "v").count() == 0
