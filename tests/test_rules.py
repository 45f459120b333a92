"""Rules against rows worked out by hand, and descriptors against published values."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from reagentql.functions import prompts as M
from reagentql.functions import scoring as S
from reagentql.functions import text as T
from reagentql.operators import control, evaluation
from reagentql.operators import molecules as C
from reagentql.operators import relational as R
from reagentql.sources import readers

c = F.col


def each(spark, rule, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.x for r in rows.select("i", rule(c("t")).alias("x")).orderBy("i").collect()]


def test_strict_rule(spark):
    good = ["CCOCC", "CC(=O)N", "Oc1ccccc1", "CC[N+](C)C", "CC/C=C/C"]
    bad = ["CCO", "c1ccccc1", "CC OC", "CC(OC", "design", "quinazoline", "NOOOOO", "CCtherefore", "[Cu+]", "CC$CC", "cccccc", "C" * 601, ""]
    assert each(spark, T.strict_ok, good + bad) == [True] * 5 + [False] * 13
    assert each(spark, lambda t: T.strict_ok(t, True), good) == [True, False, True, True, False]


def test_shape_and_verdict_rules(spark):
    texts = ["CC(C)CCCCCCO", "CC(C)C", "A Scaffold (new) here", "name: CC(C)CCCCCCO", "plainwordsonly", "estimated CC(C)C"]
    assert each(spark, T.looks_like_candidate, texts) == [True, False, False, False, False, False]
    texts = ["150 Da", "150 da", "700da", "550 Da and HIGH", "300 Da and High", "excellent but limited", "strong", "good", "weak"]
    assert each(spark, T.heuristic_verdict, texts) == ["impossible", "impossible", "impossible", "likely", "sure", "likely", "sure", "likely", "likely"]


def test_feedback_bounds(spark):
    rows = spark.createDataFrame([(0, -10.0), (1, -10.01), (2, -7.0), (3, -6.99), (4, None)], "i int, v double")
    none = F.lit(None).cast("double")
    got = [r.x for r in rows.select("i", S.feedback_text(c("v"), none, none, error=F.lit("timeout")).alias("x")).orderBy("i").collect()]
    assert got == ["binding moderate", "binding strong", "binding moderate", "binding weak", "binding failed: timeout"]
    rows = spark.createDataFrame([(0, 0.85), (1, 0.5), (2, 0.3)], "i int, d double")
    both = [S.feedback_text(none, c("d"), none, liver=k).alias(k) for k in ("evaluator", "search")]
    assert [(r.evaluator.split(" | ")[1], r.search.split(" | ")[1]) for r in rows.orderBy("i").select(*both).collect()] == [
        ("liver risk high", "liver risk very high"), ("liver risk moderate", "liver risk moderate"), ("liver risk low", "liver risk low"),
    ]


def test_original_success_bounds_cannot_be_met(spark):
    rows = spark.createDataFrame([(0.81, "high", 5.1), (0.81, "high", 1.63), (0.8, "high", 9.0), (0.9, "low", 9.0), (None, "high", 9.0)], "s double, b string, r double")
    assert [r.x for r in rows.select(S.success_case(c("s"), c("b"), c("r")).alias("x")).collect()] == [True, False, False, False, False]


def test_legacy_access(spark):
    rows = spark.createDataFrame([(300.0, 1, 0, 0.1), (600.0, 5, 2, 0.4), (None, 1, 0, 0.1)], "m double, r int, k int, h double")
    assert [r.x for r in rows.select(S.synthetic_access_legacy(c("m"), c("r"), c("k"), c("h")).alias("x")).collect()] == pytest.approx([8.0, 5.9, 3.0])


def test_exception_rows_and_verdicts(spark):
    rows = spark.createDataFrame([(1, None, 2.0, 60.0, 1, 4, -9.0, 0.1, 0.1), (2, 400.0, 2.0, 60.0, 1, 4, -9.0, 0.99, 0.1), (3, 400.0, 2.0, 60.0, 1, 4, None, 0.1, 0.1)], "id int, mw double, logp double, tpsa double, hbd int, hba int, vina double, dili double, herg double")
    got = {r.id: (r.reward > 0, r.is_pruned, r.prune_reason, r.verdict) for r in evaluation.physical_evaluation(rows).collect()}
    assert got == {1: (False, False, "no descriptors", "likely"), 2: (True, True, "dili", "impossible"), 3: (True, False, None, "likely")}


def test_corrections(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "k int, v string")
    out = control.corrected(rows((1, "ok"), (2, "no"), (3, "no"), (4, None)), [rows((1, "ok2"), (2, "ok"), (3, "no")), rows((3, "ok3"), (4, "no"))], "k", c("v").startswith("ok"))
    assert sorted((r.k, r.v, r.tries) for r in out.collect()) == [(1, "ok", 0), (2, "ok", 1), (3, "ok3", 2), (4, None, 2)]


def test_ranges_and_quantiles(spark):
    rows = spark.range(1000).select((c("id") * 7919 % 1000).alias("v"), (c("id") % 3 == 0).alias("g"), F.concat(F.lit("k"), c("id").cast("string")).alias("s"))
    by = {g: sorted(r.v for r in rows.where(c("g") == g).collect()) for g in (True, False)}
    numbered = R.numbered(rows, ["g"], "v", [], "i").collect()
    assert all(by[r.g][r.i] == r.v for r in numbered) and len(numbered) == 1000
    for share in (0.0, 0.25, 0.5, 1.0):
        got = {r.g: r.q for r in R.exact_quantile(rows, ["g"], "v", share, "q").collect()}
        for g, values in by.items():
            at = (len(values) - 1) * share
            low = int(at)
            assert got[g] == pytest.approx(values[low] + (values[min(low + 1, len(values) - 1)] - values[low]) * (at - low))
    ordered = [r.s for r in R.numbered(rows, [], "s", [], "i").orderBy("i").collect()]
    assert ordered == sorted(ordered)
    assert R.exact_quantile(rows.limit(0), [], "v", 0.5, "q").first().q is None


def test_best_first_puts_nulls_last(spark):
    rows = spark.createDataFrame([(1, 0.5), (2, None), (3, 0.9), (4, 0.5)], "p int, v double")
    assert [(r.p, r.place) for r in R.best_first(rows, "v", "p").orderBy("place").collect()] == [(3, 1), (1, 2), (4, 3), (2, 4)]


def test_best_matches_in_blocks(spark):
    import random

    from reagentql.operators import vectors as V

    rng = random.Random(3)
    word = lambda: rng.choice("abcdefghijkl")
    make = lambda n: [(i, [word() for _ in range(rng.randint(0, 9))]) for i in range(n)] + [(n, None)]
    sets, refs = make(60), make(25)
    share = lambda a, b: len(a & b) / len(a | b) if a | b else 0.0
    want = {i: round(max(share(set(t or []), set(r or [])) for _, r in refs), 6) for i, t in sets}
    frame = lambda rows: spark.createDataFrame(rows, "id int, tokens array<string>")
    for block in (4096, 4):
        assert {r.id: r.best for r in V.best_set_match(frame(sets), frame(refs), block).collect()} == want
    assert {r.best for r in V.best_set_match(frame(sets), frame(refs).limit(0)).collect()} == {0.0}


def test_answers_and_sections(spark):
    rows = spark.createDataFrame([(["a", None, "b", "c"],), ([],), (None,)], "x array<string>")
    assert [r.s for r in rows.select(M.section("T:", c("x"), 2).alias("s")).collect()] == ["T:\n- a\n- b", None, None]


@pytest.mark.parametrize(
    "line, mw, rings, hbd, hba, rotatable, tpsa",
    [
        ("CCO", 46.07, 0, 1, 1, 0, 20.23),
        ("CC(=O)Oc1ccccc1C(=O)O", 180.16, 1, 1, 4, 3, 63.60),
        ("Cn1cnc2c1c(=O)n(C)c(=O)n2C", 194.19, 2, 0, 6, 0, 61.82),
        ("CC(=O)Nc1ccc(O)cc1", 151.16, 1, 2, 3, 1, 49.33),
        ("c1ccccc1", 78.11, 1, 0, 0, 0, 0.0),
        ("C1CCC2CCCCC2C1", 138.25, 2, 0, 0, 0, 0.0),
        ("O=[N+]([O-])c1ccccc1", 123.11, 1, 0, 3, 1, 43.14),
        ("C1OC1", 44.05, 1, 0, 1, 0, 12.53),
        ("CN1CCC[C@H]1c1cccnc1", 162.23, 2, 0, 2, 1, 16.13),
        ("[Na+].[Cl-]", 58.44, 0, 0, 0, 0, 0.0),
    ],
)
def test_descriptors_of_known_molecules(line, mw, rings, hbd, hba, rotatable, tpsa):
    d = C.describe(line)
    assert d["mw"] == pytest.approx(mw, abs=0.02) and d["tpsa"] == pytest.approx(tpsa, abs=0.01)
    assert (d["rings"], d["hbd"], d["hba"], d["rotatable"]) == (rings, hbd, hba, rotatable)


def test_lines_that_cannot_be_read(spark):
    assert [C.describe(x) for x in ("C(", "C1CC", "CC)", "C==", "xyz", "[Qq]", "", None, "C11", "quinazoline")] == [None] * 10
    rows = spark.createDataFrame([("CCO", 1.0), ("C(", 2.0), (None, 3.0)], "smiles string, mw double")
    got = [(r.smiles, r.mw, r.heavy, r.bits is None) for r in C.with_descriptors(rows, prints=True).collect()]
    assert got == [("CCO", 46.069, 3, False), ("C(", None, None, True), (None, None, None, True)]


def test_fingerprints():
    same = C.fingerprint("OCC"), C.fingerprint("CCO"), C.fingerprint("C(O)C")
    assert same[0] == same[1] == same[2] and C.fingerprint("CCN") != same[0]
    share = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    one, near, far = map(C.fingerprint, ("CC(=O)Nc1ccc(O)cc1", "CC(=O)Nc1ccc(OC)cc1", "CCCCCCCC"))
    assert share(one, near) > 0.4 > share(one, far)


def test_knowledge_documents(spark, tmp_path):
    known = {"gbm_targets": [{"name": "EGFR", "mutation_types": ["v3", "amp"]}, {"name": "MGMT"}, {"description": "no name"}]}
    (tmp_path / "t.json").write_text(json.dumps(known, indent=1))
    assert [(r.name, r.mutations) for r in readers.targets(spark, str(tmp_path / "t.json")).orderBy("name").collect()] == [("EGFR", "v3, amp"), ("MGMT", "Not applicable")]
    doc = {"clinical_data": {"standard_treatment": {"surgery": "yes"}, "treatment_challenges": ["barrier"]}, "biomarkers": {"MGMT": {"use": "x"}}, "resistance_mechanisms": {"a": ["b"]}}
    (tmp_path / "c.json").write_text(json.dumps(doc))
    row = readers.clinical(spark, str(tmp_path / "c.json")).first()
    assert row.standard_treatment == {"surgery": "yes"} and row.biomarkers == {"MGMT": {"use": "x"}} and row.molecular_subtypes is None
    (tmp_path / "r.json").write_text(json.dumps({"mw": {"min": 200, "max": 500}, "logp": {"min": 1.5, "max": 4}}))
    assert {tuple(r) for r in readers.property_ranges(spark, str(tmp_path / "r.json")).collect()} == {("mw", 200.0, 500.0), ("logp", 1.5, 4.0)}
    (tmp_path / "EGFR_summary.json").write_text('{"a": 1}')
    (tmp_path / "other.json").write_text("{}")
    assert [tuple(r) for r in readers.summaries(spark, str(tmp_path)).collect()] == [("EGFR", '{"a": 1}')]
