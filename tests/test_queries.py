"""Every query with SQL against DuckDB on the small tables."""

import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__

FOLDER = "/root/testdata/sf0.001"
ORACLE = __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{FOLDER}/{f}'")
    return c


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return repr(v) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, con, name):
    df = __spark_entry__.queries()[name](spark, FOLDER)
    want = con.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    have = Counter(tuple(map(_plain, r)) for r in df.select(*want.columns).collect())
    assert have == Counter(tuple(map(_plain, r)) for r in want.fetchall())


def test_every_query_is_registered_once_and_oracles_have_queries():
    assert set(ORACLE) <= set(__spark_entry__.queries())
