"""Every registered query against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from reagentql.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        if name.endswith(".parquet"):
            con.execute(f"create view {name[:-8]} as select * from '{SF}/{name}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    return f"{float(v):.6f}" if isinstance(v, (int, float)) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    want = sorted(tuple(plain(row[names.index(c)]) for c in columns) for row in cursor.fetchall())
    assert sorted(names) == columns
    assert got == want


def test_all_have_sql():
    assert set(QUERIES) == set(ORACLES) and len(QUERIES) > 50
