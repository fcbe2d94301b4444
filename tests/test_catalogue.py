"""Every catalogue query with SQL against an independent engine, on whole small tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from annolake.plans import catalogue, problem_queries

DIR = "/root/testdata/sf0.001"
Q = {**catalogue.QUERIES, **problem_queries.QUERIES}
SQL = {**catalogue.SQL, **problem_queries.SQL}
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")


def norm(v):
    return round(v, 8) + 0.0 if isinstance(v, float) else tuple(map(norm, v)) if isinstance(v, list | tuple) else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name):
    df = Q[name](spark, DIR)
    cols = sorted(df.columns)
    r = con.sql(SQL[name])
    assert sorted(r.columns) == cols
    at = [r.columns.index(c) for c in cols]
    want = sorted(repr(tuple(norm(x[i]) for i in at)) for x in r.fetchall())
    assert sorted(repr(tuple(norm(x[c]) for c in cols)) for x in df.collect()) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
