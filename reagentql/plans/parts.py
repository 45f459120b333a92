"""Lookups, retries, residue classes, weights and combinations over the driver tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from reagentql.functions import prompts, registry
from reagentql.functions import text as T
from reagentql.operators import control
from reagentql.operators import relational as R
from reagentql.operators import structure as P
from reagentql.plans.proxies import MOL_SQL, mol, read
from reagentql.plans.relational import RES_SQL, residues

c = F.col
r6 = lambda x: F.round(x, 6)
Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def put(f):
        Q[f.__name__], SQL[f.__name__] = f, sql
        return f

    return put


@query("""WITH w AS (SELECT * FROM (VALUES (3, 0), (77, 1), (5, 2), (1, 3), (24, 4)) w(id, place)), s AS (SELECT s_nationkey AS id, list(s_suppkey ORDER BY s_suppkey) AS sites FROM supplier GROUP BY 1)
  SELECT w.id, place, n_name AS name, lower(n_name) AS sequence, coalesce(array_to_string(sites, ','), '') AS sites, coalesce(len(sites), 0) AS n_sites, r_name AS subtype
  FROM w LEFT JOIN nation ON n_nationkey = w.id LEFT JOIN s USING (id) LEFT JOIN region ON r_regionkey = n_regionkey""")
def q_lookups(spark, sf):
    """A nation's name, sequence, sites and subtype by its number; number 77 is not there."""
    sites = read(spark, sf, "supplier").groupBy(c("s_nationkey").alias("n_nationkey")).agg(F.array_sort(F.collect_list("s_suppkey")).alias("sites"))
    rows = read(spark, sf, "nation").join(read(spark, sf, "region"), c("n_regionkey") == c("r_regionkey")).join(sites, "n_nationkey", "left")
    found = R.looked_up(rows, "n_nationkey", [3, 77, 5, 1, 24], {"name": c("n_name"), "sequence": F.lower("n_name"), "sites": c("sites"), "subtype": c("r_name")})
    return found.select(c("n_nationkey").alias("id"), "place", "name", "sequence", F.array_join(c("sites").cast("array<string>"), ",").alias("sites"), F.size("sites").cast("long").alias("n_sites"), "subtype")


@query("""WITH e AS (SELECT user_id AS call, event_id AS attempt, CASE WHEN event_type = 'error' THEN 'failed at ' || event_id ELSE '' END AS warning, row_number() OVER w AS n, lag(CASE WHEN event_type = 'error' THEN 'failed at ' || event_id ELSE '' END) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
  SELECT call, attempt, CASE WHEN n > 1 AND before <> '' THEN before || chr(10) || chr(10) ELSE '' END || 'ask ' || call AS request, CASE WHEN n > 1 THEN 0.2e0 ELSE 0.8e0 END AS temperature, CASE WHEN n > 1 THEN 0.85e0 ELSE 0.95e0 END AS top_p, CAST(CASE WHEN n > 1 THEN 600 ELSE 1000 END AS INTEGER) AS tokens FROM e WHERE n <= 3""")
def q_retry_requests(spark, sf):
    warning = F.when(c("event_type") == "error", F.concat(F.lit("failed at "), c("event_id").cast("string"))).otherwise("")
    rows = read(spark, sf, "events").select(c("user_id").alias("call"), c("event_id").alias("attempt"), F.concat(F.lit("ask "), c("user_id").cast("string")).alias("prompt"), warning.alias("warning"), F.lit(1000).alias("most"))
    return control.retry_requests(rows, "call", "attempt", "prompt", "warning", "most").select("call", "attempt", "request", "temperature", "top_p", "tokens")


@query("""WITH e AS (SELECT user_id AS call, event_id, value, event_type = 'click' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
  t AS (SELECT call, min(n) FILTER (ok) AS good, max(n) AS last FROM e WHERE n <= 3 GROUP BY call), b AS (SELECT user_id AS call, max(value) AS value FROM events WHERE user_id % 2 = 0 GROUP BY 1)
  SELECT t.call, CASE WHEN good IS NOT NULL THEN g.value WHEN b.call IS NOT NULL THEN b.value ELSE l.value END AS value, CASE WHEN good IS NOT NULL THEN 'attempt' WHEN b.call IS NOT NULL THEN 'base' ELSE 'last' END AS source
  FROM t LEFT JOIN e g ON g.call = t.call AND g.n = good LEFT JOIN e l ON l.call = t.call AND l.n = last LEFT JOIN b ON b.call = t.call""")
def q_last_resort(spark, sf):
    e = read(spark, sf, "events")
    rows = e.select(c("user_id").alias("call"), c("event_id").alias("attempt"), (c("event_type") == "click").alias("ok"), "value")
    base = e.where(c("user_id") % 2 == 0).groupBy(c("user_id").alias("call")).agg(F.max("value").alias("value"))
    return control.last_resort(rows, "call", "attempt", "ok", "value", base)


# The classes are those of the operator, written out.
LISTS = {
    "hydrophobic_regions": "'ALA', 'VAL', 'LEU', 'ILE', 'MET', 'PHE', 'TRP', 'PRO'",
    "hydrogen_bond_donors": "'SER', 'THR', 'TYR', 'CYS', 'LYS', 'ARG', 'HIS', 'TRP'",
    "hydrogen_bond_acceptors": "'SER', 'THR', 'TYR', 'ASN', 'GLN', 'ASP', 'GLU', 'CYS'",
    "aromatic_regions": "'PHE', 'TYR', 'TRP', 'HIS'",
    "positive_charge": "'LYS', 'ARG', 'HIS'",
    "negative_charge": "'ASP', 'GLU'",
}


@query(f"WITH {RES_SQL} SELECT site, " + ", ".join(f"coalesce(string_agg(aa || num, ',' ORDER BY num) FILTER (aa IN ({v})), '') AS {k}" for k, v in LISTS.items()) + " FROM x GROUP BY site")
def q_pharmacophore_lists(spark, sf):
    lists = P.pharmacophore_lists(residues(spark, sf), ["site"], "aa", "num", ["num"])
    return lists.select("site", *[F.array_join(n, ",").alias(n) for n in LISTS])


@query("""WITH a AS (SELECT l_suppkey AS file, CASE l_partkey % 3 WHEN 0 THEN 'ZN' WHEN 1 THEN 'LIG' ELSE 'FE' END AS name, ['C', 'N', 'CL', 'XX'][1 + l_partkey % 4] AS e FROM lineitem)
  SELECT file, name, round(CASE name WHEN 'ZN' THEN 65.38e0 WHEN 'FE' THEN 55.85e0 ELSE sum(CASE e WHEN 'N' THEN 14.01e0 WHEN 'CL' THEN 35.45e0 ELSE 12.01e0 END) END, 4) AS weight FROM a GROUP BY file, name""")
def q_component_weights(spark, sf):
    name = F.when(c("l_partkey") % 3 == 0, "ZN").when(c("l_partkey") % 3 == 1, "LIG").otherwise("FE")
    element = F.element_at(F.array(*map(F.lit, ("C", "N", "CL", "XX"))), (c("l_partkey") % 4 + 1).cast("int"))
    atoms = read(spark, sf, "lineitem").select(c("l_suppkey").alias("file"), name.alias("name"), element.alias("e"))
    return P.component_weights(atoms, ["file"], "name", "e")


@query("SELECT p_partkey AS id, CASE WHEN p_size % 7 > 0 THEN p_size / 25e0 END AS index FROM part WHERE p_size % 7 > 0 AND p_size / 25e0 > 1")
def q_synergies(spark, sf):
    rows = read(spark, sf, "part").select(c("p_partkey").alias("id"), F.when(c("p_size") % 7 > 0, c("p_size") / 25.0).alias("index"))
    return R.synergies(rows, "index")


# Tokens made to pass or fail one part of each rule; the SQL says which.
TOKENS = """CASE o_orderkey % 8 WHEN 0 THEN concat('CC(N)CCO', o_orderkey % 9) WHEN 1 THEN 'CC N' WHEN 2 THEN 'CCmethyl(N)' WHEN 3 THEN 'thank you, CC(N)' WHEN 4 THEN '(CC)NCCO' WHEN 5 THEN 'CCO' WHEN 6 THEN 'xyzzyxyz' ELSE 'CCO design' END"""


@query("""WITH k AS (SELECT o_orderkey AS id, o_orderkey % 8 AS k, 20 + o_custkey % 140 AS s FROM orders) SELECT id, k IN (0, 2, 4, 6) AND s BETWEEN 40 AND 120 AS base, k = 0 AND s BETWEEN 20 AND 150 AS adapter, k IN (0, 1, 4, 5, 7) AS chat FROM k""")
def q_loose_rules(spark, sf):
    rows = read(spark, sf, "orders").select(c("o_orderkey").alias("id"), F.expr(TOKENS).alias("t"), (20 + c("o_custkey") % 140).cast("double").alias("s"))
    return rows.select("id", *[T.passes_loose(c("t"), rule, c("s")).alias(n) for n, rule in T.LOOSE_RULES.items()])


@query("""WITH e AS (SELECT event_id AS id, event_type AS state, event_id % 12 AS score, event_id % 3 AS b FROM events), p AS (SELECT *,
    CASE b WHEN 0 THEN CASE WHEN score > 7 THEN 'BBB: high permeability (logBB > 0); GBM Activity: high' ELSE 'BBB: good permeability (logBB > -0.5); GBM Activity: good' END || '; Toxicity: low; Selectivity: moderate'
      WHEN 1 THEN 'BBB: moderate permeability (logBB > -0.5); GBM Activity: moderate; Toxicity: moderate acceptable; Selectivity: high (GBM/normal ratio)' ELSE '' END AS by_score,
    CASE b WHEN 0 THEN 'BBB: high permeability (logBB > 0); GBM Activity: high; Toxicity: low' WHEN 1 THEN 'BBB: moderate permeability (logBB > -0.5); GBM Activity: moderate; Toxicity: moderate acceptable; Selectivity: high (GBM/normal ratio)' ELSE '' END AS plain FROM e)
  SELECT id, plain, 'Generate a GBM drug candidate SMILES for ' || state || '.' || chr(10) || 'Target metrics: ' || by_score || chr(10) || 'Output format: SMILES: <canonical_SMILES>' AS instruction FROM p""")
def q_target_metrics(spark, sf):
    b = c("event_id") % 3
    level = lambda zero, one: F.when(b == 0, zero).when(b == 1, one)
    profile = {"bbb": level("high", "moderate"), "activity": level("high", "moderate"), "toxicity": level("low", "moderate"), "selectivity": level("moderate", "high")}
    instruction = prompts.metric_instruction(c("event_type"), prompts.target_metrics(profile, c("event_id") % 12))
    return read(spark, sf, "events").select(c("event_id").alias("id"), prompts.target_metrics(profile).alias("plain"), instruction.alias("instruction"))


@query(f"WITH {MOL_SQL} SELECT id, round(greatest(-12e0, least(-4e0, -0.08e0 * mw + 0.4e0 * logp - 0.008e0 * tpsa - 5.5e0)), 6) AS docking, 1e0 AS vina_norm FROM mol")
def q_evaluators(spark, sf):
    """Scores by name, one of them replaced by a constant as a run without docking does."""
    rows = mol(spark, sf).select("id", *[c(n).cast("double").alias(n) for n in ("mw", "logp", "tpsa", "vina")])
    known = registry.default_evaluators().replaced(vina_norm=lambda vina: F.lit(1.0))
    return known.evaluate(rows, ["docking", "vina_norm"]).select("id", r6(c("docking")).alias("docking"), "vina_norm")


@query("SELECT o_orderkey AS id, 'numbered' AS rule, 0 AS place, concat('CC', o_orderkey % 9) AS token FROM orders UNION ALL SELECT o_orderkey, 'numbered', 1, concat('OC', o_custkey % 9) FROM orders UNION ALL SELECT o_orderkey, 'listed', 0, concat('NC', o_custkey % 9) FROM orders")
def q_table_functions(spark, sf):
    """Extraction rules called from SQL, in LATERAL joins."""
    text = "concat('SMILES 1: CC', o_orderkey % 9, chr(10), 'SMILES 2: OC', o_custkey % 9, chr(10), '3. NC', o_custkey % 9)"
    registry.register_table_functions(spark)
    read(spark, sf, "orders").selectExpr("o_orderkey AS id", f"{text} AS text").createOrReplaceTempView("table_function_texts")
    parts = [f"SELECT id, '{n}' AS rule, x.place, x.token FROM table_function_texts, LATERAL extract_{n}(text) x" for n in ("numbered", "listed")]
    return spark.sql(" UNION ALL ".join(parts))
