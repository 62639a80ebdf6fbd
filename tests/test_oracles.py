"""Every query that has SQL, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from postlens.plans.queries import ORACLE_SQL, QUERIES

HERE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(HERE):
        c.sql(f"create view {t.removesuffix('.parquet')} as select * from '{HERE}/{t}'")
    return c


@pytest.mark.skipif(not os.path.isdir(HERE), reason="no tables here")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):
    got, want = QUERIES[name](spark, HERE).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    rows = lambda x: sorted(map(tuple, x[cols].astype(str).replace({"None": "nan", "<NA>": "nan", "NaT": "nan"}).values.tolist()))
    assert rows(got) == rows(want)
