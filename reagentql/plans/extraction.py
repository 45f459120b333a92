"""Further extraction rules, over texts made to hold known candidates; the SQL says what each was made to hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from reagentql.functions import text as T
from reagentql.plans.proxies import read
from reagentql.sources.readers import spread

c = F.col
Q: dict = {}
SQL: dict[str, str] = {}
BASE = "WITH d AS (SELECT o_orderkey AS id, o_orderkey % 9 AS a, o_custkey % 7 AS b, o_orderkey % 4 AS k FROM orders) "


def query(sql: str):
    def put(f):
        Q[f.__name__], SQL[f.__name__] = f, BASE + sql
        return f

    return put


def texts(spark, sf, text: str):
    rows = read(spark, sf, "orders").selectExpr("o_orderkey AS id", "o_orderkey % 9 AS a", "o_custkey % 7 AS b", "o_orderkey % 4 AS k")
    rows = spread(rows)  # extraction is costly, and the table one small file
    return rows.select("id", F.expr(text).alias("t"))


@query("SELECT id, CASE k WHEN 0 THEN concat('CC(N)C', a) WHEN 1 THEN concat('CCO(C)N', a) WHEN 2 THEN concat('CC(C)NO', b) END AS token FROM d")
def q_labelled_first(spark, sf):
    text = "CASE k WHEN 0 THEN concat('so SMILES: CC(N)C', a) WHEN 1 THEN concat('分子结构：CCO(C)N', a) WHEN 2 THEN concat('The compound CC(C)NO', b, ' is new') ELSE 'nothing here' END"
    return texts(spark, sf, text).select("id", T.labelled_first(c("t")).alias("token"))


@query("""SELECT id, r.p AS pattern, CAST(r.i AS INTEGER) AS position, r.m AS match, r.v AS valid FROM (SELECT id, unnest([
    {'p': 0, 'i': 0, 'm': concat('C1', a), 'v': false}, {'p': 1, 'i': 0, 'm': concat('CC(N)C', a), 'v': true}, {'p': 2, 'i': 0, 'm': 'smiles', 'v': false},
    {'p': 2, 'i': 1, 'm': concat('CC(N)C', a), 'v': true}, {'p': 2, 'i': 2, 'm': 'or', 'v': false}, {'p': 2, 'i': 3, 'm': 'SMILES', 'v': false},
    {'p': 2, 'i': 4, 'm': concat('C1', a), 'v': false}]) AS r FROM d)""")
def q_extraction_trace(spark, sf):
    rows = T.rows_of(texts(spark, sf, "concat('smiles: CC(N)C', a, ' or SMILES: C1', a)"), T.extraction_trace(c("t")), ["id"], "match")
    return rows.select("id", "pattern", "position", "match", "valid")


@query("SELECT id, concat('CC(=O)NCC', a, 'O') AS tokens FROM d")
def q_embedded(spark, sf):
    text = "concat('Therefore(C)C=ON is not, but CC(=O)NCC', a, 'O and Nothing(NO)ing nor CCCCCCCCC=C, again CC(=O)NCC', a, 'O')"
    return texts(spark, sf, text).select("id", F.array_join(T.embedded_candidates(c("t")), " ").alias("tokens"))


@query("SELECT id, concat('CC(N)O', a, ' SMILES1 SMILES2 OCC(F)N', b) AS tokens FROM d")
def q_several_patterns(spark, sf):
    text = "concat('SMILES1: CC(N)O', a, '; SMILES2: CCCCC; and OCC(F)N', b)"
    return texts(spark, sf, text).select("id", F.array_join(T.several_patterns(c("t")), " ").alias("tokens"))


@query("SELECT id, concat('CC(N)C', a, ' OCC(F)', b, ' NCCO(C)', a) AS tokens FROM d")
def q_extract_lines(spark, sf):
    text = r"concat('- CC(N)C', a, chr(10), '2. OCC(F)', b, ', none; SMILES: NCCO(C)', a)"
    return texts(spark, sf, text).select("id", F.array_join(T.extract_lines(c("t")), " ").alias("tokens"))


@query("SELECT id, concat('CNCOC CC(=O)1(N)', a) AS tokens FROM d")
def q_bracket_candidates(spark, sf):
    text = "concat('[P][P][P] ### Response: take <s>[C][N][C][O][C] or', chr(10), '1. SMILES: CC(=O)1(N)', a, chr(10), 'the molecule (C)1(C)2(C)3, plain words only')"
    return texts(spark, sf, text).select("id", F.array_join(T.bracket_candidates(c("t")), " ").alias("tokens"))


@query("SELECT id, CASE WHEN k = 0 THEN concat('OCCNC', a) ELSE concat('CCNCC', a, ' OCCCO', b) END AS tokens FROM d")
def q_reclaimed(spark, sf):
    text = "CASE WHEN k = 0 THEN concat('OCC(F)NC', a, ' (available)') ELSE concat('CCNC(N)C', a, ' (available), This is step 2 of it, OCCCO', b, '; x') END"
    return texts(spark, sf, text).select("id", F.array_join(T.reclaimed(c("t")), " ").alias("tokens"))


@query("""SELECT id, r.t AS token, r.c AS context FROM (SELECT id, unnest([{'t': concat('CCOCC', a, 'N'), 'c': 'target_phrase'}, {'t': concat('OCC(F)CN', b), 'c': 'smiles_label'},
    {'t': concat('OCCCN', b), 'c': 'step_line'}, {'t': concat('NCCOCC', b), 'c': 'step_line'}, {'t': concat('NCCSC', a), 'c': 'paren_prefix'}, {'t': 'CCCCNOCCC1', 'c': 'greedy_pattern'}]) AS r FROM d)""")
def q_target_candidates(spark, sf):
    text = """concat('To synthesize CCOCC', a, 'N, do this.', chr(10), 'SMILES 1: OCC(F)CN', b, ';', chr(10), 'Step 2 uses CCCCNOCCC1', chr(10), 'NCCSC', a, ' (available)', chr(10), 'Result NCCOCC', b)"""
    return T.rows_of(texts(spark, sf, text), T.target_candidates(c("t")), ["id"])


@query("""SELECT id, r.n AS name, r.r AS rationale, CAST(r.m AS INTEGER) AS base_mw, r.b AS bbb_potential FROM (SELECT id, unnest(CASE
    WHEN k IN (0, 1) THEN [{'n': concat('ring ', a), 'r': 'fits', 'm': 100 + b, 'b': 'high'}, {'n': concat('core ', b), 'r': 'Suitable for GBM drug design', 'm': 150, 'b': 'medium'}]
    WHEN k = 2 THEN [{'n': 'indole', 'r': 'Suitable scaffold for indole', 'm': 170, 'b': 'high'}, {'n': 'purine', 'r': 'Suitable scaffold for purine', 'm': 190, 'b': 'high'}, {'n': 'thiazole', 'r': 'Suitable scaffold for thiazole', 'm': 210, 'b': 'medium'}]
    ELSE [] END) AS r FROM d)""")
def q_scaffold_proposals(spark, sf):
    text = """CASE WHEN k IN (0, 1) THEN concat('Scaffold 1:', chr(10), 'Name: ring ', a, chr(10), 'Rationale: fits', chr(10), 'Base MW: ', 100 + b, ' Da', chr(10), 'BBB Potential: High', chr(10), 'Name: core ', b)
      WHEN k = 2 THEN 'We like Thiazole, indole or purine, perhaps morpholine.' ELSE 'no idea' END"""
    return T.rows_of(texts(spark, sf, text), T.scaffold_proposals(c("t")), ["id"], "name")


@query("""SELECT id, CASE k WHEN 0 THEN concat('acrylamide ', a) WHEN 1 THEN 'epoxide' ELSE 'acrylamide' END AS warhead, CASE k WHEN 1 THEN 'methoxy' ELSE 'fluorine' END AS enhancers,
    CAST(CASE k WHEN 0 THEN 400 + b WHEN 1 THEN 312 ELSE 450 END AS INTEGER) AS mw, CASE k WHEN 0 THEN '2-3' ELSE '2.5-3.5' END AS logp, CASE k WHEN 0 THEN '60-80' ELSE '60-90' END AS tpsa,
    CASE k WHEN 0 THEN 'good' WHEN 1 THEN 'Extracted from output: warhead=epoxide' ELSE 'Extracted from output: warhead=acrylamide' END AS rationale FROM d""")
def q_assembly_strategies(spark, sf):
    text = """CASE k WHEN 0 THEN concat('Strategy 1:', chr(10), 'Warhead: acrylamide ', a, chr(10), 'BBB Enhancers: fluorine', chr(10), 'Estimated Total MW: ', 400 + b, ' Da', chr(10), 'Expected LogP: 2-3', chr(10), 'Expected TPSA: 60-80', chr(10), 'Rationale: good')
      WHEN 1 THEN 'an Epoxide with methoxy of 312 units' ELSE 'no idea' END"""
    return T.rows_of(texts(spark, sf, text), T.assembly_strategies(c("t")), ["id"], "warhead")
