"""Every registered catalogue query against its SQL equivalent, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from strandwise.plans import catalog

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()


def rows(data, cols):
    at = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(f"{r[i]:.6g}" if isinstance(r[i], float) else str(r[i]) for i in at) for r in data)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    if name not in ORACLE:
        assert got
        return
    want = con.execute(ORACLE[name])
    cols = [x[0] for x in want.description]
    assert sorted(df.columns) == sorted(cols)
    assert rows(got, df.columns) == rows(want.fetchall(), cols)
