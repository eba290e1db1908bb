"""Every query with SQL gives DuckDB's rows at sf0.001."""

import duckdb
import pytest

import __spark_entry__ as entry
from gatewarden.plans import oracle, queries

SF = "/root/testdata/sf0.001"
SQL = oracle.oracle_sql()


def rows(columns, data):
    order = sorted(columns)
    return sorted(tuple("" if v is None else f"{v:.5f}" if isinstance(v, float) else str(v) for v in (r[columns.index(c)] for c in order)) for r in data)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("events", "pages", "documents"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    got = queries.queries()[name](spark, SF)
    want = duck.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert queries.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 7
