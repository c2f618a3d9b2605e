"""Every registered query over the logs against its SQL, run by DuckDB on the same tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from meterlark.plans import queries


@pytest.fixture(scope="module")
def tables(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _near(a, b) -> bool:
    """Equal but for the last rounded digit of a float."""
    if isinstance(a, float) and isinstance(b, float):
        return a == b or abs(a - b) <= 2e-6 + 1e-9 * abs(b)
    return a == b


@pytest.mark.parametrize("query", queries.ALL, ids=lambda q: q.name)
def test_query(spark, sf, tables, query):
    df = query.run(spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=str)
    names = ", ".join(f'"{c}"' for c in columns)
    want = sorted(tables.execute(f"SELECT {names} FROM ({query.sql})").fetchall(), key=str)
    assert len(got) == len(want)
    assert all(_near(a, b) for x, y in zip(got, want, strict=True) for a, b in zip(x, y, strict=True)), [(x, y) for x, y in zip(got, want, strict=True) if x != y][:3]
