"""Every query with SQL gives the rows that DuckDB gives for it."""

from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from wavelake.plans import catalogue, coded, files, hearing, positions  # noqa: F401

from .conftest import SF


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, Decimal)):
        return round(float(v), 6)
    return int(v) if isinstance(v, int) else str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_rows_as_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    want = duck.execute(catalogue.SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows_of(got.columns, got.collect()) == rows_of(columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["track", "peak", "rms", "dc"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
