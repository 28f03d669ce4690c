"""Catalog queries against their SQL on the smallest tables, where these are there."""

from pathlib import Path

import pytest

from patternloom.catalog import CATALOG

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", [n for n, (_, sql) in CATALOG.items() if sql])
def test_same_rows(spark, duck, name):
    query, sql = CATALOG[name]
    df, want = query(spark, str(DATA)), duck.sql(sql)
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    order = [want.columns.index(c) for c in cols]
    assert sorted(str(tuple(r)) for r in df.select(*cols).collect()) == sorted(str(tuple(r[i] for i in order)) for r in want.fetchall())


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(CATALOG) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
