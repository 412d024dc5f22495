"""Every query against its SQL in another engine."""

import os

import pytest

from gleanspark.plans import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)
    if name not in SQL:
        assert got
        return
    found = duck.sql(SQL[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    want = sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=key)
    plain = lambda rows: [tuple("NaN" if x != x else x for x in r) for r in rows]
    assert plain(got) == plain(want)
