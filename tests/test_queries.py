"""The driver's queries against their SQL, on the small tables."""

import glob
import os

import duckdb
import pytest

from lodeworks import catalog


@pytest.fixture(scope="module")
def tables(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.fixture(scope="module")
def sf_dir():
    return "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", catalog.ORACLES)
def test_oracle(spark, tables, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    want = tables.sql(catalog.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    got = sorted(repr(tuple(r)) for r in df.select(*want.columns).collect())
    assert got == sorted(map(repr, want.fetchall()))


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
