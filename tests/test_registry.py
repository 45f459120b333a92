"""Evaluators by name and SQL table functions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from reagentql.functions import registry
from reagentql.functions import text as T


def test_evaluators(spark):
    rows = spark.createDataFrame([(300.0, 2.0, 60.0, None), (900.0, 2.0, 10.0, -20.0)], "mw double, logp double, tpsa double, vina double")
    known = registry.default_evaluators()
    got = known.evaluate(rows, ["vina_norm", "tpsa_norm", "mw_norm"]).orderBy("mw").collect()
    assert [(r.vina_norm, r.tpsa_norm, r.mw_norm) for r in got] == [(0.5, 1.0, 1.0), (1.0, -1.0, 0.0)]
    constant = known.replaced(vina_norm=lambda v: F.lit(0.25))
    assert {r.vina_norm for r in constant.evaluate(rows, ["vina_norm"]).collect()} == {0.25}
    assert {r.vina_norm for r in known.evaluate(rows, ["vina_norm"]).collect()} == {0.5, 1.0}
    known.add("double", ("mw",), lambda mw: mw * 2)
    assert known.evaluate(rows, ["double"]).agg(F.sum("double")).first()[0] == 2400.0
    for bad in (lambda: known.add("double", (), F.lit), lambda: known.replaced(nothing=F.lit), lambda: known.evaluate(rows, ["nothing"]), lambda: known.evaluate(rows.drop("vina"), ["vina_norm"])):
        with pytest.raises((KeyError, ValueError)):
            bad()


def test_table_functions_equal_columns(spark):
    texts = ["1. CCO\n2) 'C\\C'\nSMILES 3: CN", "smiles: CCO(C)N and SMILES = OCC", "", None, "nothing"]
    spark.createDataFrame(list(enumerate(texts)), "id int, text string").createOrReplaceTempView("some_texts")
    assert registry.register_table_functions(spark) == ["extract_numbered", "extract_labelled", "extract_listed"]
    for name, pattern in registry.TABLE_FUNCTIONS.items():
        sql = spark.sql(f"SELECT id, x.place, x.token FROM some_texts, LATERAL extract_{name}(text) x")
        plain = spark.table("some_texts").select("id", F.posexplode(T.extract_all(F.col("text"), pattern)).alias("place", "token"))
        assert sql.schema.simpleString() == "struct<id:int,place:int,token:string>"
        assert sorted(map(tuple, sql.collect())) == sorted(map(tuple, plain.collect())) != []
    registry.register_table_functions(spark, {"own": "(x+)"}, "find_")
    assert [r.token for r in spark.sql("SELECT * FROM find_own('axxbx')").collect()] == ["xx", "x"]
