"""Boundary values of the scoring expressions."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from reagentql.functions import scoring as S
from reagentql.functions import text as T


def values(spark, column, rows, ddl):
    return [r[0] for r in spark.createDataFrame(rows, ddl).select(column).collect()]


def test_tpsa_norm(spark):
    rows = [(x,) for x in (19.99, 20.0, 30.0, 40.0, 90.0, 115.0, 140.0, 140.01)] + [(None,)]
    got = values(spark, S.tpsa_norm(F.col("t")), rows, "t double")
    want = [-1, 0.5, 0.75, 1, 1, 0, -1, -1, None]
    assert all(a == b or a == pytest.approx(b) for a, b in zip(got, want))


def test_mw_norm(spark):
    got = values(spark, S.mw_norm(F.col("m")), [(150.0,), (300.0,), (500.0,), (600.0,), (800.0,)], "m double")
    assert got == pytest.approx([0.5, 1, 1, 0.5, 0])


def test_log_bb_penalties_are_strict(spark):
    rows = [(2.0, 50.0, 450.0, 2, 6), (2.0, 50.0, 450.01, 3, 7), (None, None, None, None, None)]
    x = S.log_bb(*[F.col(n) for n in ("logp", "tpsa", "mw", "hbd", "hba")])
    got = values(spark, x, rows, "logp double, tpsa double, mw double, hbd int, hba int")
    line = 0.152 * 2 - 0.0148 * 50 + 0.139
    assert got == pytest.approx([line, line - 0.45, -2.0])


def test_bands(spark):
    got = values(spark, S.bbb_band(F.col("x")), [(-0.1,), (-0.0999,), (-0.3,), (-0.5,)], "x double")
    assert got == ["medium", "high", "low", "very_low"]


def test_vina_null_is_half(spark):
    assert values(spark, S.vina_norm(F.col("v")), [(None,), (-7.5,), (-12.0,), (0.0,)], "v double") == pytest.approx([0.5, 0.4375, 1, 0])


def test_prune_order_and_forgiveness(spark):
    rows = [(-4.9, 0.99, 0.1, 300.0, 50.0, None), (-6.0, 0.97, 0.1, 300.0, 50.0, 0.93), (-6.0, 0.99, 0.1, 300.0, 50.0, 0.93), (-6.0, 0.99, 0.1, 300.0, 50.0, None), (-6.0, 0.1, 0.1, 300.0, 19.0, None)]
    names = ("vina", "dili", "herg", "mw", "tpsa")
    x = S.prune_reason(*[F.col(n) for n in names], base_dili=F.col("b"))
    assert values(spark, x, rows, "vina double, dili double, herg double, mw double, tpsa double, b double") == ["vina", None, "dili", "dili", "tpsa_low"]


def test_reward_is_geometric_and_zero_for_bad_surface(spark):
    x = S.reward(*[F.col(n) for n in "abcdef"])
    got = values(spark, x, [(0.5, 0.5, 0.5, 0.5, 0.5, 0.5), (1.0, 0.0, 0.0, 1.0, -0.1, 1.0)], ", ".join(f"{n} double" for n in "abcdef"))
    assert got == pytest.approx([0.5, 0.0])


def test_verdict(spark):
    assert values(spark, S.verdict(F.col("r")), [(0.6999,), (0.7,), (0.1,)], "r double") == ["likely", "sure", "likely"]
    assert values(spark, S.verdict(F.col("r"), strict=True), [(0.3999,), (0.4,)], "r double") == ["impossible", "likely"]


def test_fisher_clips(spark):
    got = values(spark, S.fisher_z(F.col("r")), [(1.0,), (None,), (0.5,)], "r double")
    assert got == pytest.approx([math.atanh(0.999999), 0, math.atanh(0.5)])


def test_text_rules(spark):
    rows = [("CC(=O)OCC",), ("CC(OCC",), ("smiles",), ("[NH4+]",), ("hello",), ("C1CC1N",)]
    assert values(spark, T.strict_ok(F.col("s")), rows, "s string") == [True, False, False, False, False, True]
    assert values(spark, T.strict_ok(F.col("s"), compat=True), rows[:1], "s string") == [False]
    assert values(spark, T.format_ok(F.col("s")), rows, "s string") == [True, True, False, True, False, True]


def test_cascade_prefers_numbered_lines(spark):
    text = "SMILES 1: CCO1CN\nSMILES: CCCC(N)O\n1. CCCCCN1"
    assert values(spark, T.extract_cascade(F.col("t")), [(text,), ("nothing",)], "t string") == [["CCO1CN"], []]
