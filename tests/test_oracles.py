"""Every registered query of the library against its SQL in DuckDB."""

import os

import duckdb
import pytest

from linkloom.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return con


def rows(cols, found):
    order = sorted(range(len(cols)), key=lambda k: cols[k])
    clean = lambda x: float(f"{x:.9g}") if isinstance(x, float) else x
    return sorted((tuple(clean(r[k]) for k in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    if name not in catalog.ORACLES:
        assert got
        return
    want = duck.sql(catalog.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, got) == rows(want.columns, want.fetchall())
