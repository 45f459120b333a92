"""Prompts and guidance from the driver tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from reagentql.functions import prompts as M
from reagentql.plans.proxies import MOL_SQL, mol, read

c = F.col
Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def put(f):
        Q[f.__name__], SQL[f.__name__] = f, sql
        return f

    return put


@query("""WITH n AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey % 4 > 0 THEN n_name END AS target, r_name, n_nationkey AS k FROM nation JOIN region ON n_regionkey = r_regionkey)
  SELECT id, CASE WHEN target IS NULL THEN 'Design freely.' || chr(10) || chr(10) || 'mw: 200-' || (300 + k)
    ELSE 'Design a molecule for ' || r_name || '.' || chr(10) || chr(10) || 'Target ' || target || CASE WHEN k % 3 = 0 THEN chr(10) || chr(10) || 'Insights:' || chr(10) || '- one' || chr(10) || '- two' ELSE '' END
      || chr(10) || chr(10) || 'mw: 200-' || (300 + k) || CASE WHEN k > 12 THEN chr(10) || chr(10) || 'Advice:' || chr(10) || '- lower lipophilicity' ELSE '' END END AS prompt FROM n""")
def q_domain_prompt(spark, sf):
    n = read(spark, sf, "nation").join(F.broadcast(read(spark, sf, "region")), c("n_regionkey") == c("r_regionkey"))
    k = c("n_nationkey")
    target = F.when(k % 4 > 0, F.concat(F.lit("Target "), "n_name"))
    insights = M.section("Insights:", F.when(k % 3 == 0, F.array(F.lit("one"), F.lit("two"), F.lit("three"))), 2)
    limits = F.array_join(M.constraint_lines({"mw": (F.lit(200), k + 300), "tpsa": (F.lit(40), F.lit(None))}), "\n")
    guidance = M.structural_guidance(F.lit(None).cast("string"), F.when(k > 12, 5.0).otherwise(3.0), F.lit(400.0))
    prompt = M.domain_prompt("Design a molecule for {specific_requirements}.", "Design freely.", c("r_name"), target, insights, limits, guidance)
    return n.select(k.alias("id"), prompt.alias("prompt"))


@query("""WITH s AS (SELECT s_nationkey AS k, list(s_name ORDER BY s_suppkey)[1:3] AS l FROM supplier GROUP BY 1)
  SELECT n_nationkey AS id, n_name || chr(10) || chr(10) || 'Think in steps.' || CASE WHEN l IS NOT NULL THEN chr(10) || chr(10) || 'Similar molecules:' || chr(10) || array_to_string(list_transform(l, lambda x: '- ' || x), chr(10)) ELSE '' END AS prompt FROM nation LEFT JOIN s ON k = n_nationkey""")
def q_reasoning_prompt(spark, sf):
    near = read(spark, sf, "supplier").groupBy(c("s_nationkey").alias("n_nationkey")).agg(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))).alias("l"))
    rows = read(spark, sf, "nation").join(near, "n_nationkey", "left")
    names = F.transform("l", lambda x: x["s_name"])
    return rows.select(c("n_nationkey").alias("id"), M.reasoning_prompt(c("n_name"), "Think in steps.", F.lit(None).cast("string"), names).alias("prompt"))


@query("""SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN NULL ELSE CASE WHEN p_size > 20 THEN 'Feedback on the previous candidate:' || chr(10) || 'too large' || chr(10) || chr(10) ELSE '' END
  || CASE WHEN p_size % 3 = 1 THEN 'Name a scaffold for ' || p_brand || '.' ELSE 'Assemble ' || p_type || ' for ' || p_brand || '.' END END AS prompt FROM part""")
def q_step_prompt(spark, sf):
    templates = {1: "Name a scaffold for {target}.", 2: "Assemble {parent} for {target}."}
    feedback = F.when(c("p_size") > 20, "too large")
    return read(spark, sf, "part").select(c("p_partkey").alias("id"), M.step_prompt(templates, c("p_size") % 3, feedback, target=c("p_brand"), parent=c("p_type")).alias("prompt"))


@query(f"""WITH {MOL_SQL} SELECT id, nullif(concat_ws(chr(10), CASE target WHEN 'EGFR' THEN 'hinge binders help' END, CASE WHEN logp < 2 OR logp > 4 OR mw > 500 THEN concat_ws(chr(10), 'Advice:', CASE WHEN logp < 2 THEN '- raise lipophilicity' WHEN logp > 4 THEN '- lower lipophilicity' END, CASE WHEN mw > 500 THEN '- reduce the size' END) END), '') AS guidance FROM mol""")
def q_guidance(spark, sf):
    known = F.when(c("target") == "EGFR", "hinge binders help")
    return mol(spark, sf).select("id", M.structural_guidance(known, c("logp"), c("mw")).alias("guidance"))


@query("""WITH x AS (SELECT DISTINCT l_suppkey AS site, l_partkey AS p FROM lineitem), l AS (SELECT site, list('R' || p ORDER BY p)[1:5] AS r FROM x GROUP BY site), g AS (SELECT site % 50 AS target, site, r, row_number() OVER (PARTITION BY site % 50 ORDER BY site) AS i FROM l)
  SELECT target, string_agg(i || '. site ' || site || ': ' || array_to_string(r, ', '), chr(10) ORDER BY i) AS summary FROM g WHERE i <= 3 GROUP BY target""")
def q_site_summary(spark, sf):
    rows = read(spark, sf, "lineitem").select(c("l_suppkey").alias("site"), c("l_partkey").alias("p")).distinct()
    sites = rows.groupBy("site").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    named = F.struct("site", F.concat(F.lit("site "), c("site").cast("string")).alias("site_name"), F.transform("ps", lambda p: F.concat(F.lit("R"), p.cast("string"))).alias("key_residues"))
    targets = sites.groupBy((c("site") % 50).alias("target")).agg(F.array_sort(F.collect_list(named)).alias("sites"))
    return targets.select("target", M.site_summary(c("sites")).alias("summary"))


@query("""WITH k AS (SELECT o_orderkey AS id, 'drug-' || o_orderkey AS key, o_orderkey % 5 AS m FROM orders), h AS (SELECT id, m, CAST('0x' || substr(md5('scaffold-' || key), 1, 8) AS BIGINT) % 1073741824 % 2 AS s, CAST('0x' || substr(md5('change-' || key), 1, 8) AS BIGINT) % 7 AS c, CAST('0x' || substr(md5('share-' || key), 1, 8) AS BIGINT) % 100 AS p FROM k),
  l AS (SELECT id, m, CASE WHEN m = 0 THEN 'CC(=O)Nc1ccccc1' ELSE replace(['c1ccccc1C(=O)NCc2ccccc2', 'NC(=O)c1ccc(cc1)O'][1 + s], 'C(=O)N', 'C(=O)N' || CASE WHEN p < 30 THEN ['', 'C', 'CC', 'O', 'N', 'Cl', 'F'][1 + c] ELSE '' END) END AS line FROM h)
  SELECT id, line, CASE WHEN m IN (1, 2) THEN 'SMILES: ' || line ELSE 'CCO' END AS response FROM l""")
def q_seeded_lines(spark, sf):
    rows = read(spark, sf, "orders").select(c("o_orderkey").alias("id"), F.concat(F.lit("drug-"), c("o_orderkey").cast("string")).alias("key"), (c("o_orderkey") % 5).alias("m"))
    scaffolds = F.when(c("m") > 0, F.array(F.lit("c1ccccc1C(=O)NCc2ccccc2"), F.lit("NC(=O)c1ccc(cc1)O")))
    rows = rows.withColumn("line", M.seeded_line(c("key"), scaffolds))
    given = F.when(c("m") == 1, "<placeholder>").when(c("m") != 2, "CCO")
    return rows.select("id", "line", M.answered(given, c("line")).alias("response"))


@query(f"""WITH {MOL_SQL}, d AS (SELECT id, alerts, round(CAST(dili AS DOUBLE) - lag(CAST(dili AS DOUBLE)) OVER (PARTITION BY cust ORDER BY id), 6) AS delta FROM mol)
  SELECT id, concat_ws(chr(10), CASE WHEN alerts >= 1 THEN 'aniline: mask it' END, CASE WHEN alerts >= 2 THEN 'epoxide: look for a safer group' END, CASE WHEN delta > 0.05 THEN printf('DILI rose by %.2f', delta) END) AS feedback FROM d""")
def q_toxicity_feedback(spark, sf):
    from reagentql.operators.relational import parent_delta

    rows = parent_delta(mol(spark, sf).select("id", "cust", "alerts", c("dili").cast("double").alias("dili")), "cust", [c("id")], "dili")
    found = F.array_compact(F.array(F.when(c("alerts") >= 1, "aniline"), F.when(c("alerts") >= 2, "epoxide"), F.when(c("alerts") >= 3, "aniline")))
    return rows.select("id", M.toxicity_feedback(found, {"aniline": "mask it"}, "look for a safer group", {"DILI": c("delta")}).alias("feedback"))
