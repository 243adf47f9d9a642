"""Every registered query of the wiki engine against its SQL, on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from folioforge.plans import catalog

DATA = "/root/testdata/sf0.001"


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    flat = lambda v: None if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted((tuple(flat(r[i]) for i in order) for r in data), key=str)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p).removesuffix('.parquet')} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    got = catalog.QUERIES[name](spark, DATA)
    data = got.collect()
    if name not in catalog.ORACLE_SQL:
        assert got.columns
        return
    want = db.sql(catalog.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, data) == rows(want.columns, want.fetchall())
