"""Every registered query of the library against its SQL in DuckDB, over whole small tables."""

import math
from pathlib import Path

import duckdb
import pytest

from weftline.plans import analytics, clustering, decisions, extras, ingestion, lists, registry, reports, rules, searches, texts  # noqa: F401  queries register themselves

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    return value


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    rows = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=str)
    if name not in registry.SQL:
        assert rows
        return
    found = duck.execute(registry.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    assert rows == sorted((tuple(plain(r[k]) for k in places) for r in found.fetchall()), key=str)
