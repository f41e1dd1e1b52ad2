"""The corpus queries against their SQL, over whole tables."""

import glob
import os

import duckdb
import pytest

from lodeworks.llm import queries


@pytest.fixture(scope="module")
def tables(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", queries.ORACLES)
def test_oracle(spark, tables, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    want = tables.sql(queries.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    got = sorted(repr(tuple(r)) for r in df.select(*want.columns).collect())
    assert got == sorted(map(repr, want.fetchall()))
