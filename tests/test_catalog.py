"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import check_oracle
from sentrilake.plans.catalog import QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in check_oracle.TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    query = QUERIES[name]
    df = query.run(spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted(repr([check_oracle.norm(v) for v in r]) for r in df.select(*cols).collect())
    if query.sql is None:
        assert got
        return
    rel = duck.sql(query.sql)
    assert sorted(rel.columns) == cols
    want = rel.select(*[f'"{c}"' for c in cols]).fetchall()
    assert got == sorted(repr([check_oracle.norm(v) for v in r]) for r in want)
