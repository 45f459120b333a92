"""Molecules exactly on the bounds of permeability, by queries and by their SQL."""

from __future__ import annotations

import duckdb
import pytest

from reagentql.plans import catalog
from tests.test_oracle import plain

#: Order and customer numbers whose penalties, subtracted as one sum, give the other side of a bound.
ON_BOUNDS = [
    (5131292, 785758), (1575098, 54352), (3087440, 756810), (7772690, 577560),
    (5437300, 99950), (581545, 805705), (6492400, 40850), (5551300, 771950),
    (1402699, 152151), (8896795, 476455), (5312095, 119155), (8077000, 736250),
]


@pytest.mark.parametrize("name", ["q_bbb_bands", "q_composite_assessment", "q_cube", "q_feedback_text", "q_rollup_report"])
def test_rows_on_bounds(spark, tmp_path, name):
    spark.createDataFrame(ON_BOUNDS, "o_orderkey long, o_custkey long").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    df = catalog.queries()[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    want = con.execute(catalog.oracle_sql()[name])
    at = [df.columns.index(d[0]) for d in want.description]
    rows = sorted(tuple(plain(r[i]) for i in at) for r in df.collect())
    assert rows == sorted(tuple(map(plain, r)) for r in want.fetchall())
