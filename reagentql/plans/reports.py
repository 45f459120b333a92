"""Run reports, normalisation, deltas and dataset rows over the driver tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from reagentql.functions import text as T
from reagentql.operators import relational as R
from reagentql.plans.proxies import MOL_SQL, mol, read
from reagentql.plans.relational import ATTEMPT, attempts
from reagentql.plans.scores import SCORED_SQL, scored

c = F.col
Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def put(f):
        Q[f.__name__], SQL[f.__name__] = f, sql
        return f

    return put


@query(f"WITH {ATTEMPT} SELECT target, count(*) AS n, count(DISTINCT key) AS n_distinct, round(avg(attempt), 6) AS mean_length, round(count(DISTINCT key) / count(*), 6) AS rate, printf('%.1f%%', round(100e0 * count(DISTINCT key) / count(*), 1)) AS shown FROM a GROUP BY target")
def q_run_summary(spark, sf):
    return R.run_summary(attempts(spark, sf), "target", "key", c("attempt"))


@query(f"WITH {MOL_SQL}, m AS (SELECT id, CAST(mw AS DOUBLE) AS mw, CAST(vina AS DOUBLE) AS vina FROM mol), e AS (SELECT avg(mw) AS a, stddev_samp(mw) AS s, avg(vina) AS b, stddev_samp(vina) AS t FROM m) SELECT id, round((mw - a) / s, 6) AS mw, round((vina - b) / t, 6) AS vina FROM m, e")
def q_z_scores(spark, sf):
    rows = mol(spark, sf).select("id", c("mw").cast("double").alias("mw"), c("vina").cast("double").alias("vina"))
    return R.z_scores(rows, ["mw", "vina"]).select("id", F.round("mw", 6).alias("mw"), F.round("vina", 6).alias("vina"))


@query(f"""WITH {MOL_SQL}, d AS (SELECT id, CAST(dili AS DOUBLE) AS dili, round(CAST(dili AS DOUBLE) - lag(CAST(dili AS DOUBLE)) OVER (PARTITION BY cust ORDER BY id), 6) AS delta FROM mol)
  SELECT id, delta, dili > 0.95 AND coalesce(delta <= 0.05, false) AS forgiven, CASE WHEN delta > 0.05 THEN printf('DILI rose by %.2f', delta) END AS message FROM d""")
def q_parent_delta(spark, sf):
    rows = R.parent_delta(mol(spark, sf).select("id", "cust", c("dili").cast("double").alias("dili")), "cust", [c("id")], "dili")
    forgiven = (c("dili") > 0.95) & F.coalesce(c("delta") <= 0.05, F.lit(False))
    return rows.select("id", "delta", forgiven.alias("forgiven"), F.when(c("delta") > 0.05, F.format_string("DILI rose by %.2f", c("delta"))).alias("message"))


PROPERTIES, SCORES = ("mw", "logp", "tpsa"), ("composite", "act", "tox")


@query(SCORED_SQL + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM s" for a in PROPERTIES for b in SCORES))
def q_property_corr(spark, sf):
    return R.cross_correlations(scored(spark, sf), list(PROPERTIES), list(SCORES))


@query("""WITH a AS (SELECT 'single' AS kind, p_partkey AS key, p_name || ' with score ' || printf('%.2f', p_retailprice) AS text FROM part WHERE p_size >= 25 ORDER BY key LIMIT 100),
  b AS (SELECT 'combined' AS kind, s_suppkey AS key, s_name || ' with index above one' AS text FROM supplier WHERE s_acctbal / 1000 > 1.0 ORDER BY key LIMIT 50) SELECT * FROM a UNION ALL SELECT * FROM b""")
def q_balanced_rows(spark, sf):
    one = read(spark, sf, "part").where("p_size >= 25")
    one = one.select(F.lit("single").alias("kind"), c("p_partkey").alias("key"), F.concat("p_name", F.lit(" with score "), F.format_string("%.2f", "p_retailprice")).alias("text"))
    two = read(spark, sf, "supplier").where(c("s_acctbal") / 1000 > 1.0)
    two = two.select(F.lit("combined").alias("kind"), c("s_suppkey").alias("key"), F.concat("s_name", F.lit(" with index above one")).alias("text"))
    return R.balanced(one, two, ["key"], 100)


@query(SCORED_SQL + "SELECT id, mw <= 700 AS valid, CASE WHEN mw <= 700 THEN round(composite, 6) ELSE 0 END AS score, CASE WHEN mw <= 700 THEN NULL ELSE 'too heavy' END AS error FROM s")
def q_unified_rows(spark, sf):
    rows = scored(spark, sf).withColumn("valid", c("mw") <= 700)
    result = F.when(c("valid"), F.struct(F.round("composite", 6).alias("score"), F.lit(None).cast("string").alias("error")))
    rows = rows.withColumn("result", result.otherwise(F.struct(F.lit(0.0).alias("score"), F.lit("too heavy").alias("error"))))
    return rows.select("id", "valid", "result.score", "result.error")


@query("""WITH m AS (SELECT l_partkey AS old, max_by(l_suppkey, {'a': l_shipdate, 'b': l_orderkey, 'c': l_suppkey}) AS new FROM lineitem WHERE l_quantity < 10 GROUP BY 1)
  SELECT p_size AS size, CAST(sum(coalesce(new, p_partkey)) AS BIGINT) AS total, count(new) AS mapped FROM part LEFT JOIN m ON old = p_partkey GROUP BY 1""")
def q_renumber(spark, sf):
    lines = read(spark, sf, "lineitem").where("l_quantity < 10")
    rows = read(spark, sf, "part").select("p_size", "p_partkey", c("p_partkey").alias("number"))
    # A number that the mapping lacks stays, so the mapped ones are those it holds.
    rows = R.renumber(rows, "number", lines, "l_partkey", "l_suppkey", ["l_shipdate", "l_orderkey", "l_suppkey"])
    held = lines.select(c("l_partkey").alias("p_partkey"), F.lit(1).alias("held")).distinct()
    return rows.join(held, "p_partkey", "left").groupBy(c("p_size").alias("size")).agg(F.sum("number").alias("total"), F.count("held").alias("mapped"))


@query("SELECT event_type AS target, round(avg(value) FILTER (user_id IN (SELECT c_custkey FROM customer WHERE c_nationkey < 13)), 6) AS mean FROM events GROUP BY 1")
def q_mean_of_selected(spark, sf):
    rows = read(spark, sf, "events").select(c("event_type").alias("target"), c("user_id").alias("key"), "value")
    return R.mean_of_selected(rows, "target", "value", read(spark, sf, "customer").where("c_nationkey < 13").select(c("c_custkey").alias("key")), ["key"])


FIXES = {"nitro": "replace by nitrile", "aldehyde": "reduce or mask"}
ALERTS = "CASE o_orderkey % 4 WHEN 0 THEN {a}'nitro', 'aldehyde', 'nitro'{b} WHEN 1 THEN {a}'thiol', 'nitro'{b} WHEN 2 THEN {a}'aldehyde'{b} ELSE {a}'thiol'{b} END"
LINE = "a || ': ' || CASE a " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FIXES.items()) + " ELSE 'remove' END"


@query(f"WITH x AS (SELECT o_orderkey AS id, {ALERTS.format(a='[', b=']')} AS l FROM orders) SELECT id, array_to_string(list_transform(list_filter(l, lambda v, i: list_position(l, v) = i), lambda a: {LINE}), chr(10)) AS lines FROM x")
def q_alert_lines(spark, sf):
    alerts = F.expr(ALERTS.format(a="array(", b=")"))
    return read(spark, sf, "orders").select(c("o_orderkey").alias("id"), T.alert_lines(alerts, FIXES, "remove").alias("lines"))
