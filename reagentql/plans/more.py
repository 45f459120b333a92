"""Selections, joins, reports, control and evaluation over the driver tables, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reagentql.functions import scoring as S
from reagentql.operators import control, evaluation, molecules
from reagentql.operators import relational as R
from reagentql.operators import structure as P
from reagentql.plans.proxies import MOL_SQL, mol, read
from reagentql.plans.relational import ATTEMPT, attempts
from reagentql.plans.scores import BBBN, MN, PRUNE, REWARD, SCORED_SQL, TN, VN, scored

c = F.col
r6 = lambda x: F.round(x, 6)
Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def put(f):
        Q[f.__name__], SQL[f.__name__] = f, sql
        return f

    return put


@query(SCORED_SQL + "SELECT id, target, composite FROM s WHERE composite >= 0.6 ORDER BY composite DESC, id LIMIT 10")
def q_above_threshold(spark, sf):
    return R.above(scored(spark, sf), "composite", 0.6, 10, [c("id")]).select("id", "target", "composite")


@query("SELECT o_orderkey AS id, o_orderpriority AS status FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') ORDER BY o_orderkey LIMIT 10")
def q_with_status(spark, sf):
    rows = read(spark, sf, "orders").select(c("o_orderkey").alias("id"), c("o_orderpriority").alias("status"))
    return R.with_status(rows, "status", ("1-URGENT", "2-HIGH"), [c("id")])


@query(SCORED_SQL + "SELECT id, composite, row_number() OVER (ORDER BY composite DESC, id) AS place FROM s")
def q_best_first(spark, sf):
    return R.best_first(scored(spark, sf).select("id", "composite"), "composite", "id")


@query(f"WITH {MOL_SQL}, r AS (SELECT id, cust, CASE WHEN id % 7 > 0 THEN round({REWARD}, 6) END AS reward FROM mol) SELECT cust, id, reward FROM (SELECT *, row_number() OVER (PARTITION BY cust ORDER BY coalesce(reward, 0) DESC, id) AS n FROM r) WHERE n = 1")
def q_best_of_branch(spark, sf):
    rows = _evaluated(spark, sf).select("id", "cust", F.when(c("id") % 7 > 0, r6(c("reward"))).alias("reward"))
    return R.best_of(rows, "cust", "reward", ["id"]).select("cust", "id", "reward")


def _evaluated(spark, sf, **options):
    rows = mol(spark, sf)
    return evaluation.physical_evaluation(rows.select("id", "cust", *[c(n).cast("double").alias(n) for n in ("mw", "logp", "tpsa", "vina", "dili", "herg")], "hbd", "hba"), **options)


@query("""WITH p AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY l_orderkey), e AS (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_orderkey % 3 = 0) SELECT p.k AS k, n, s FROM p LEFT JOIN e ON p.k = e.k""")
def q_matched_by_key(spark, sf):
    proposals = read(spark, sf, "lineitem").groupBy(c("l_orderkey").alias("k")).agg(F.count("*").alias("n"))
    evaluations = read(spark, sf, "orders").where("o_orderkey % 3 = 0").select(c("o_orderkey").alias("k"), c("o_orderstatus").alias("s"))
    return R.matched(proposals, evaluations, ["k"]).select("k", "n", "s")


@query("""WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'), r AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY ALL),
  j AS (SELECT l.event_id, r.value, row_number() OVER (PARTITION BY l.event_id ORDER BY r.ts DESC) AS n FROM l LEFT JOIN r ON l.user_id = r.user_id AND r.ts <= l.ts) SELECT event_id, value FROM j WHERE n = 1""")
def q_asof(spark, sf):
    e = read(spark, sf, "events")
    views = e.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return R.asof(e.where("event_type = 'click'").select("event_id", "user_id", "ts"), views, "user_id", "ts", ["value"]).select("event_id", "value")


@query("""WITH i AS (SELECT p_partkey AS part, CAST(p_size AS DOUBLE) * 20 AS low, CAST(p_size AS DOUBLE) * 20 + 30 AS high, p_partkey % 5 AS g FROM part), x AS (SELECT s_suppkey AS supp, s_acctbal AS bal, s_suppkey % 5 AS g FROM supplier)
  SELECT supp, count(*) AS n, min(part) AS first_part FROM x JOIN i ON x.g = i.g AND bal BETWEEN low AND high GROUP BY supp""")
def q_within_intervals(spark, sf):
    size = c("p_size").cast("double") * 20
    spans = read(spark, sf, "part").select(c("p_partkey").alias("part"), size.alias("low"), (size + 30).alias("high"), (c("p_partkey") % 5).alias("g"))
    points = read(spark, sf, "supplier").select(c("s_suppkey").alias("supp"), c("s_acctbal").alias("at"), (c("s_suppkey") % 5).alias("g"))
    return R.within_intervals(points, spans, "g", "at", "low", "high", 50.0).groupBy("supp").agg(F.count("*").alias("n"), F.min("part").alias("first_part"))


@query("SELECT c_custkey, o_orderkey FROM customer FULL JOIN (SELECT * FROM orders WHERE o_orderkey % 4 = 0) ON c_custkey = o_custkey AND c_custkey % 2 = 0")
def q_full_outer(spark, sf):
    orders = read(spark, sf, "orders").where("o_orderkey % 4 = 0").select("o_orderkey", "o_custkey")
    customers = read(spark, sf, "customer").select("c_custkey")
    return customers.join(orders, (c("c_custkey") == c("o_custkey")) & (c("c_custkey") % 2 == 0), "full").select("c_custkey", "o_orderkey")


@query("SELECT event_id, round(sum(value) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS last3, first_value(event_id) OVER w AS first_id, last_value(event_id) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_id, CAST(ntile(4) OVER w AS INTEGER) AS quarter FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def q_frames(spark, sf):
    w = Window.partitionBy("user_id").orderBy("event_id")
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return read(spark, sf, "events").select(
        "event_id", F.round(F.sum("value").over(w.rowsBetween(-2, 0)), 4).alias("last3"), F.first("event_id").over(w).alias("first_id"), F.last("event_id").over(every).alias("last_id"), F.ntile(4).over(w).alias("quarter")
    )


@query("""WITH m AS (SELECT event_type AS state, event_id, value / 100 AS score, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events WHERE value / 100 >= 0.8) SELECT state, event_id, score FROM m WHERE n <= 50""")
def q_per_state(spark, sf):
    rows = read(spark, sf, "events").select(c("event_type").alias("state"), "event_id", (c("value") / 100).alias("score"))
    return R.per_state(rows, "state", "score", 0.8, 50, [c("event_id")])


TEMPLATES = ("Answer first.", "Reasons first.", "Both at once.")


@query("SELECT p_partkey AS id, ['Answer first.', 'Reasons first.', 'Both at once.'][1 + CAST('0x' || substr(md5('42-' || p_partkey), 1, 8) AS BIGINT) % 3] AS template, CASE WHEN p_size > 25 THEN 'large' END AS kind, CASE WHEN p_size > 25 THEN 500e0 ELSE 350e0 END AS mw FROM part")
def q_template_pick(spark, sf):
    # A literal of properties per kind, and one of the templates by hash.
    large = F.struct(F.lit("large").alias("kind"), F.lit(500.0).alias("mw"))
    other = F.struct(F.lit(None).cast("string").alias("kind"), F.lit(350.0).alias("mw"))
    rows = read(spark, sf, "part").select(c("p_partkey").alias("id"), F.when(c("p_size") > 25, large).otherwise(other).alias("p"))
    return R.template_pick(rows, "id", TEMPLATES, "template").select("id", "template", "p.kind", "p.mw")


@query("SELECT count(*) AS total, count(*) FILTER (user_id % 9 > 0) AS success, count(*) FILTER (user_id % 9 = 0) AS failed FROM events")
def q_outcomes(spark, sf):
    return R.outcome_counts(read(spark, sf, "events").withColumn("error", F.when(c("user_id") % 9 == 0, "failed")), "error")


@query("SELECT lang AS value, count(*) AS n FROM documents GROUP BY lang")
def q_value_counts(spark, sf):
    return R.value_counts(read(spark, sf, "documents"), "lang")


@query(SCORED_SQL + "SELECT target, band, CAST(grouping(target) * 2 + grouping(band) AS BIGINT) AS level, count(*) AS n, round(avg(composite), 6) AS mean FROM s GROUP BY CUBE(target, band)")
def q_cube(spark, sf):
    return R.grouped_reports(scored(spark, sf), [["target", "band"], ["target"], ["band"], []], [F.count("*").alias("n"), r6(F.avg("composite")).alias("mean")])


@query("""SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS shown, strftime(ts, '%Y%m%d_%H%M%S') AS stamp, CAST(epoch(date_trunc('month', ts)) AS BIGINT) AS month, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS days,
  CAST(floor(epoch(ts + INTERVAL '36 hours')) AS BIGINT) AS later, CAST(floor(epoch(ts)) - floor(epoch(min(ts) OVER (PARTITION BY user_id))) AS BIGINT) AS elapsed FROM events""")
def q_times(spark, sf):
    ts = c("ts").cast("timestamp")
    first = F.min("ts").over(Window.partitionBy("user_id")).cast("timestamp")
    return read(spark, sf, "events").select(
        "event_id",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("shown"),
        F.date_format("ts", "yyyyMMdd_HHmmss").alias("stamp"),
        F.unix_timestamp(F.date_trunc("month", ts)).alias("month"),
        F.date_diff(c("ts").cast("date"), F.lit("2024-01-01").cast("date")).alias("days"),
        F.unix_timestamp(ts + F.expr("INTERVAL 36 HOURS")).alias("later"),
        (F.unix_timestamp(ts) - F.unix_timestamp(first)).alias("elapsed"),
    )


@query(f"""WITH {MOL_SQL}, m AS (SELECT id, id % 11 > 0 AS ok, CAST(mw AS DOUBLE) AS mw, CAST(logp AS DOUBLE) AS logp, CAST(tpsa AS DOUBLE) AS tpsa, hbd, hba, CAST(vina AS DOUBLE) AS vina, CAST(dili AS DOUBLE) AS dili, CAST(herg AS DOUBLE) AS herg FROM mol),
  e AS (SELECT id, ok, CASE WHEN ok THEN {VN} ELSE 0 END AS vina_norm, CASE WHEN ok THEN {BBBN} ELSE 0 END AS bbb_norm, CASE WHEN ok THEN {TN} ELSE 0 END AS tpsa_norm, CASE WHEN ok THEN {MN} ELSE 0 END AS mw_norm, CASE WHEN ok THEN {REWARD} ELSE 0 END AS reward, CASE WHEN ok THEN ({PRUNE}) ELSE 'no descriptors' END AS prune_reason FROM m)
  SELECT id, round(vina_norm, 6) AS vina_norm, round(bbb_norm, 4) AS bbb_norm, round(tpsa_norm, 6) AS tpsa_norm, round(mw_norm, 6) AS mw_norm, round(reward, 4) AS reward, prune_reason, ok AND prune_reason IS NOT NULL AS is_pruned, CASE WHEN NOT ok THEN 'likely' WHEN prune_reason IS NOT NULL THEN 'impossible' WHEN reward >= 0.7 THEN 'sure' ELSE 'likely' END AS verdict FROM e""")
def q_physical_evaluation(spark, sf):
    rows = mol(spark, sf).select("id", F.when(c("id") % 11 > 0, c("mw").cast("double")).alias("mw"), *[c(n).cast("double").alias(n) for n in ("logp", "tpsa", "vina", "dili", "herg")], "hbd", "hba")
    out = evaluation.physical_evaluation(rows)
    return out.select(*S.shown(["id", "bbb_norm", "reward"]), r6(c("vina_norm")).alias("vina_norm"), r6(c("tpsa_norm")).alias("tpsa_norm"), r6(c("mw_norm")).alias("mw_norm"), "prune_reason", "is_pruned", "verdict")


@query(f"""WITH {MOL_SQL}, m AS (SELECT id, CAST(vina AS DOUBLE) AS vina, CAST(dili AS DOUBLE) AS dili, CAST(mw AS DOUBLE) AS mw, CAST(tpsa AS DOUBLE) AS tpsa, CAST(logp AS DOUBLE) AS logp, hbd, hba, CAST(herg AS DOUBLE) AS herg FROM mol)
  SELECT id, CASE WHEN vina > -6 THEN 'vina' WHEN dili > 0.5 THEN 'dili' WHEN herg > 0.9 THEN 'herg' WHEN mw < 200 OR mw > 700 THEN 'mw' WHEN tpsa > 140 THEN 'tpsa_high' WHEN tpsa < 20 THEN 'tpsa_low' END AS prune_reason,
  round(CASE WHEN {TN} < 0 THEN 0 ELSE greatest(0e0, least(1e0, exp(0.5e0 * ln(greatest({VN}, 1e-8)) + 0.5e0 * ln(greatest(1 - dili, 1e-8))))) END, 6) AS reward FROM m""")
def q_own_weights(spark, sf):
    weights = S.Weights(vina=0.5, dili=0.5, herg=0.0, bbb=0.0, physchem=0.0)
    out = _evaluated(spark, sf, weights=weights, cutoffs=S.Cutoffs(vina=-6.0, dili=0.5))
    return out.select("id", "prune_reason", r6(c("reward")).alias("reward"))


@query(f"""WITH {MOL_SQL} SELECT id, round(greatest(1e0, least(10e0, 8 - greatest(0e0, CAST(mw AS DOUBLE) - 500) / 100e0 - 0.5e0 * greatest(0, rings - 3) - 0.3e0 * chiral + CASE WHEN hba / CAST(heavy AS DOUBLE) > 0.3e0 THEN 0.5e0 ELSE 0 END)), 6) AS access FROM mol""")
def q_access_legacy(spark, sf):
    return mol(spark, sf).select("id", r6(S.synthetic_access_legacy(c("mw").cast("double"), c("rings"), c("chiral"), c("hba") / c("heavy").cast("double"))).alias("access"))


LINE = "concat('CC(=O)', repeat('Cl', CAST(o_orderkey % 3 AS INTEGER)), CASE o_custkey % 3 WHEN 0 THEN 'c1ccncc1' WHEN 1 THEN '[Zn]CC' ELSE '[n+]CC' END, repeat('N=O', CAST(o_custkey % 2 AS INTEGER)))"


@query("""WITH k AS (SELECT o_orderkey AS id, o_orderkey % 3 AS a, o_custkey % 2 AS b, o_custkey % 3 AS m FROM orders)
  SELECT id, a + b AS reactive, a + b > 0 AS herg, a + b >= 2 AS cyp, concat_ws(', ', CASE WHEN a > 0 THEN concat('chloride(', a, ')') END, CASE WHEN b > 0 THEN concat('nitroso(', b, ')') END) AS named, m IN (0, 2) AS aromatic_n,
    CASE WHEN a + b < 3 THEN round(0.1e0 * (a + b), 1) ELSE 0.5e0 END AS toxicity_score FROM k""")
def q_alert_counts(spark, sf):
    rows = read(spark, sf, "orders").select(c("o_orderkey").alias("id"), F.expr(LINE).alias("line"))
    found = F.array(*[F.struct(F.lit(n).alias("name"), S.occurrences(c("line"), p).alias("count")) for n, p in (("chloride", "Cl"), ("nitroso", "N=O"))])
    rows = rows.withColumn("m", found).withColumn("reactive", F.aggregate("m", F.lit(0).cast("long"), lambda a, x: a + x["count"]))
    score = S.or_missing(c("reactive") < 3, "toxicity", toxicity_score=F.round(0.1 * c("reactive"), 1))["toxicity_score"]
    return rows.select("id", "reactive", S.any_alert(c("m")).alias("herg"), S.cyp_flag(c("m")).alias("cyp"), F.array_join(S.named_counts(c("m")), ", ").alias("named"), S.aromatic_nitrogen(c("line")).alias("aromatic_n"), score)


@query("""WITH t AS (SELECT DISTINCT CASE o_orderkey % 3 WHEN 0 THEN concat('CC(N)CCCCCCO', o_custkey % 50) WHEN 1 THEN concat('weight ', 150 + o_custkey % 500, ' Da, high affinity') ELSE 'a scaffold with strong (good) affinity' END AS text, o_orderkey % 3 AS k, o_custkey % 50 AS n, 150 + o_custkey % 500 AS m FROM orders),
  d AS (SELECT DISTINCT text, k, CASE WHEN k = 0 THEN n END AS n, CASE WHEN k = 1 THEN m END AS m FROM t) SELECT text, CASE WHEN k = 0 AND n % 2 = 0 THEN 'impossible' WHEN k = 0 THEN 'likely' WHEN k = 2 THEN 'sure' WHEN m < 200 OR m > 600 THEN 'impossible' WHEN m > 500 OR m < 250 THEN 'likely' ELSE 'sure' END AS verdict FROM d""")
def q_batch_verdicts(spark, sf):
    text = "CASE o_orderkey % 3 WHEN 0 THEN concat('CC(N)CCCCCCO', o_custkey % 50) WHEN 1 THEN concat('weight ', 150 + o_custkey % 500, ' Da, high affinity') ELSE 'a scaffold with strong (good) affinity' END"
    texts = read(spark, sf, "orders").select(F.expr(text).alias("text"))
    known = spark.range(0, 50, 2).select(F.concat(F.lit("CC(N)CCCCCCO"), c("id").cast("string")).alias("smiles"), F.lit("impossible").alias("verdict"))
    return evaluation.verdicts(texts, known)


CELLS = """WITH g AS (SELECT vec_id AS cell, unnest(range(64)) AS gene, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), s AS (SELECT gene, v AS w FROM g WHERE cell = 0 AND gene < 40), j AS (SELECT cell, v, w FROM g JOIN s USING (gene)),
  r AS (SELECT cell, rank() OVER (PARTITION BY cell ORDER BY v) + (count(*) OVER (PARTITION BY cell, v) - 1) / 2e0 AS rv, rank() OVER (PARTITION BY cell ORDER BY w) + (count(*) OVER (PARTITION BY cell, w) - 1) / 2e0 AS rw FROM j),
  p AS (SELECT cell, greatest(-0.999999e0, least(0.999999e0, corr(rv, rw))) AS c FROM r GROUP BY cell), z AS (SELECT cell, round(0.5e0 * ln((1 + c) / (1 - c)), 5) AS z FROM p), e AS (SELECT min(z) AS l, max(z) AS h FROM z), n AS (SELECT cell, (z - l) / (h - l) AS z FROM z, e) """


@query(CELLS + "SELECT cell, round(z, 6) AS z, (SELECT round(avg(z), 6) FROM n WHERE cell % 10 = 1) AS mean FROM n")
def q_connection_scores(spark, sf):
    cells = read(spark, sf, "embeddings").select(c("vec_id").alias("cell"), F.posexplode("embedding").alias("gene", "v")).select("cell", "gene", c("v").cast("double").alias("value"))
    signature = cells.where("cell = 0 AND gene < 40").select("gene", c("value").alias("weight"))
    chosen = read(spark, sf, "embeddings").where("vec_id % 10 = 1").select(c("vec_id").alias("cell"))
    out = evaluation.connection_scores(cells, signature, "minmax", chosen)
    return out.select("cell", r6(c("z")).alias("z"), r6(c("mean")).alias("mean"))


@query("""WITH s AS (SELECT s_nationkey AS k, list(s_suppkey ORDER BY s_suppkey) AS sites FROM supplier GROUP BY 1), p AS (SELECT c_nationkey AS k, count(*) AS hydrophobic, count(*) FILTER (c_custkey % 2 = 0) AS donors FROM customer GROUP BY 1)
  SELECT n_name AS target_id, len(n_name) AS sequence_length, coalesce(array_to_string(list_transform(sites, lambda x: 'pocket ' || x), ','), '') AS pockets, coalesce(hydrophobic, 0) AS hydrophobic_count, coalesce(donors, 0) AS donor_count, CAST(coalesce(least(5, hydrophobic), 0) AS INTEGER) AS n_key_residues FROM nation LEFT JOIN s ON s.k = n_nationkey LEFT JOIN p ON p.k = n_nationkey""")
def q_model_input(spark, sf):
    sites = read(spark, sf, "supplier").groupBy(c("s_nationkey").alias("n_nationkey")).agg(F.array_sort(F.collect_list(F.struct(c("s_suppkey").alias("site_id"), c("s_name").alias("site_name")))).alias("binding_sites"))
    groups = read(spark, sf, "customer").groupBy(c("c_nationkey").alias("n_nationkey")).agg(F.collect_list("c_custkey").alias("hydrophobic_regions"), F.collect_list(F.when(c("c_custkey") % 2 == 0, c("c_custkey"))).alias("hydrogen_bond_donors"))
    rows = read(spark, sf, "nation").join(sites, "n_nationkey", "left").join(groups, "n_nationkey", "left")
    rows = rows.select(c("n_name").alias("name"), c("n_name").alias("sequence"), "binding_sites", F.struct("hydrophobic_regions", "hydrogen_bond_donors").alias("pharmacophore_features"))
    out = P.model_input(rows)
    pockets = F.array_join(F.transform("binding_pockets", lambda p: F.concat(F.lit("pocket "), p["pocket_id"].cast("string"))), ",")
    key = P.key_residues(c("pharmacophore_features"), {"hydrophobic_regions": 5})["hydrophobic_regions"]
    out = out.join(rows.select(c("name").alias("target_id"), key.alias("key")), "target_id")
    return out.select("target_id", c("sequence_length").cast("long").alias("sequence_length"), pockets.alias("pockets"), c("pharmacophore.hydrophobic_regions").cast("long").alias("hydrophobic_count"), c("pharmacophore.hydrogen_bond_donors").cast("long").alias("donor_count"), F.size("key").alias("n_key_residues"))


@query("SELECT n_name AS name, CAST(len(n_name) AS INTEGER) AS length, CAST(count(s_suppkey) AS INTEGER) AS sites FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey WHERE n_nationkey IN (1, 3, 5, 77) GROUP BY ALL")
def q_compare_targets(spark, sf):
    sites = read(spark, sf, "supplier").groupBy(c("s_nationkey").alias("n_nationkey")).agg(F.collect_list("s_suppkey").alias("binding_sites"))
    rows = read(spark, sf, "nation").join(sites, "n_nationkey", "left").select("n_nationkey", c("n_name").alias("name"), c("n_name").alias("sequence"), "binding_sites")
    return P.compare_targets(rows, "n_nationkey", [1, 3, 5, 77]).select("name", "length", "sites")


@query(f"WITH {ATTEMPT}, n AS (SELECT target, key, min(pos) AS pos FROM a GROUP BY ALL), f AS (SELECT key, pos, arg_min(target, pos) OVER (PARTITION BY key) AS t, row_number() OVER (PARTITION BY key ORDER BY pos) AS i, target FROM n) SELECT key, target || '_' || lpad(CAST(row_number() OVER (PARTITION BY target ORDER BY pos) - 1 AS VARCHAR), 5, '0') AS seq_id FROM f WHERE i = 1")
def q_rebuilt_ids(spark, sf):
    return R.rebuilt_ids(attempts(spark, sf), "target", "key", "pos").select("key", "seq_id")


@query("SELECT n_nationkey AS id, replace(replace(n_name || '/x y', '/', '_'), ' ', '_') AS name, CASE WHEN n_nationkey % 3 = 0 THEN 'EGFR' WHEN n_nationkey % 3 = 1 THEN 'TP53' END AS gene FROM nation")
def q_canonical_names(spark, sf):
    words = F.when(c("n_nationkey") % 3 == 0, "Epidermal Growth Factor Receptor, chain A").when(c("n_nationkey") % 3 == 1, "cellular tumor antigen P53").otherwise("unknown")
    return read(spark, sf, "nation").select(c("n_nationkey").alias("id"), R.canonical_names(F.concat("n_name", F.lit("/x y"))).alias("name"), P.gene_of(words)["gene"].alias("gene"))


# --- search control over recorded responses


@query("""WITH e AS (SELECT user_id AS call, event_id AS attempt, value AS score, event_type <> 'error' AS ok FROM events), g AS (SELECT call, max(attempt) FILTER (ok AND score > 50) AS best, count(*) AS n FROM e GROUP BY call)
  SELECT g.call, best AS attempt, score, n, best IS NOT NULL AS solved FROM g LEFT JOIN e ON e.attempt = best""")
def q_retries(spark, sf):
    e = read(spark, sf, "events").select(c("user_id").alias("call"), c("event_id").alias("attempt"), c("value").alias("score"), ((c("event_type") != "error") & (c("value") > 50)).alias("ok"))
    return control.last_good(e, "call", "attempt", "ok", ["score"])


@query("""WITH m AS (SELECT user_id AS k, arg_min(value, event_id) AS a FROM events WHERE event_type = 'view' GROUP BY 1), f AS (SELECT user_id AS k, arg_min(value, event_id) AS b FROM events WHERE event_type = 'click' GROUP BY 1), u AS (SELECT DISTINCT user_id AS k FROM events)
  SELECT k, coalesce(a, b) AS value, CASE WHEN a IS NOT NULL THEN 'primary' WHEN b IS NOT NULL THEN 'fallback' END AS source FROM u LEFT JOIN m USING (k) LEFT JOIN f USING (k)""")
def q_fallback(spark, sf):
    e = read(spark, sf, "events").select(c("user_id").alias("k"), "event_id", "event_type", "value")
    first = lambda kind: e.where(c("event_type") == kind).groupBy("k").agg(F.min_by("value", "event_id").alias("value"))
    return control.with_fallback(e.select("k").distinct(), first("view"), first("click"), "k", "value")


@query("""WITH o AS (SELECT user_id AS run, event_id AS call, value, sum(value) OVER w AS spent, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT run, count(*) FILTER (n <= 8 AND spent - value < 600) AS made, count(*) FILTER (NOT (n <= 8 AND spent - value < 600)) AS refused FROM o GROUP BY run""")
def q_budget(spark, sf):
    rows = read(spark, sf, "events").select(c("user_id").alias("run"), c("event_id").alias("call"), "value")
    marked = control.within_budget(rows, "run", ["call"], "value", 8, 600.0)
    return marked.groupBy("run").agg(F.count_if("allowed").alias("made"), F.count_if(~c("allowed")).alias("refused"))


@query("SELECT count(*) FILTER (event_type = 'error') AS parse_failed, count(*) FILTER (value > 90) AS over_limit, count(*) AS calls FROM events")
def q_guardrails(spark, sf):
    rules = {"parse_failed": c("event_type") == "error", "over_limit": c("value") > 90}
    return control.guardrails(read(spark, sf, "events"), rules)


TREE = """WITH l1 AS (SELECT n_nationkey AS node, CAST(NULL AS INTEGER) AS parent, 0 AS round, (n_nationkey * 37 % 100) / 100e0 AS reward, n_nationkey % 7 = 0 AS pruned FROM nation),
  k1 AS (SELECT node, CAST(node AS VARCHAR) AS path FROM (SELECT *, row_number() OVER (ORDER BY reward DESC, node) AS i FROM l1 WHERE NOT pruned) WHERE i <= 3),
  l2 AS (SELECT s_suppkey AS node, s_nationkey AS parent, s_suppkey % 2 AS round, (s_suppkey * 41 % 97) / 100e0 AS reward, s_suppkey % 5 = 0 AS pruned FROM supplier),
  d2 AS (SELECT l2.*, path || '>' || l2.node AS path FROM l2 JOIN k1 ON l2.parent = k1.node WHERE NOT pruned), h AS (SELECT coalesce(max(reward) FILTER (round = 0), 0) >= 0.65 AS stop FROM d2),
  b2 AS (SELECT d2.* FROM d2, h WHERE round = 0 OR NOT stop) """


@query(TREE + "SELECT node, reward, path FROM (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY reward DESC, node) AS i FROM b2) WHERE i <= 3")
def q_tree_search(spark, sf):
    """Three best nations, then their suppliers in two rounds of refinement; the second round is made only if the first has no reward of 0.65."""
    return control.tree_search(_tree_levels(spark, sf), 3, 0.65).select(c("node").cast("long").alias("node"), "reward", F.array_join("path", ">").alias("path"))


def _tree_levels(spark, sf):
    first = read(spark, sf, "nation").select(F.lit(None).cast("long").alias("parent"), c("n_nationkey").cast("long").alias("node"), F.lit(0).alias("round"), ((c("n_nationkey") * 37 % 100) / 100.0).alias("reward"), (c("n_nationkey") % 7 == 0).alias("pruned"))
    second = read(spark, sf, "supplier").select(c("s_nationkey").cast("long").alias("parent"), c("s_suppkey").cast("long").alias("node"), (c("s_suppkey") % 2).cast("int").alias("round"), ((c("s_suppkey") * 41 % 97) / 100.0).alias("reward"), (c("s_suppkey") % 5 == 0).alias("pruned"))
    return [first, second]


# Every model and prompt made the same responses, so that the trees of the variants can be written by hand.
@query(TREE.rstrip() + """,
  t AS (SELECT node, reward, path, row_number() OVER (PARTITION BY parent ORDER BY reward DESC, node) AS i FROM b2),
  plain AS (SELECT node, reward, path, row_number() OVER (PARTITION BY parent ORDER BY reward DESC, node) AS i FROM d2 WHERE round = 0),
  kc AS (SELECT node, CAST(node AS VARCHAR) AS path FROM l1 ORDER BY node LIMIT 3),
  same AS (SELECT l2.node, 1e0 AS reward, path || '>' || l2.node AS path, row_number() OVER (PARTITION BY l2.parent ORDER BY l2.node) AS i FROM l2 JOIN kc ON l2.parent = kc.node WHERE round = (SELECT min(round) FROM l2 JOIN kc ON l2.parent = kc.node)),
  one AS (SELECT node, reward, CAST(node AS VARCHAR) AS path, row_number() OVER (ORDER BY reward DESC, node) AS i FROM l2 WHERE NOT pruned AND (round = 0 OR NOT (SELECT max(reward) >= 0.65 FROM l2 WHERE NOT pruned AND round = 0))),
  basic AS (SELECT node, 1e0 AS reward, CAST(node AS VARCHAR) AS path, row_number() OVER (ORDER BY node) AS i FROM l2 WHERE round = (SELECT min(round) FROM l2)),
  every AS (SELECT unnest(['full', 'generic_prompt', 'general_adapter']) AS variant, * FROM t UNION ALL SELECT 'no_feedback', * FROM plain UNION ALL SELECT 'constant_evaluator', * FROM same
    UNION ALL SELECT unnest(['single_step', 'reasoning', 'direct']), * FROM one UNION ALL SELECT 'base_only', * FROM basic)
  SELECT variant, node, reward, path FROM every WHERE i <= 3""")
def q_search_variants(spark, sf):
    """The tree of q_tree_search in all variants: whole ones, and those that go without feedback, evaluation or levels."""
    first, second = _tree_levels(spark, sf)
    made = first.withColumn("level", F.lit(0)).unionByName(second.withColumn("level", F.lit(1)))
    pairs = sorted({(v.model, v.prompt) for v in control.VARIANTS})
    responses = made.withColumn("__p", F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(p).alias("prompt")) for m, p in pairs]))).select("*", "__p.*").drop("__p")
    runs = [control.variant_search(responses, v, 3, 0.65, 2) for v in control.VARIANTS]
    return reduce(DataFrame.unionByName, runs).select("variant", "node", "reward", F.array_join("path", ">").alias("path"))


@query("WITH t AS (SELECT event_type AS target, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY 1) SELECT r.target, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'empty' ELSE 'saved' END AS status FROM (VALUES ('view'), ('click'), ('error'), ('none')) r(target) LEFT JOIN t USING (target)")
def q_run_targets(spark, sf):
    made = read(spark, sf, "events").where("event_type <> 'error'").select(c("event_type").alias("target"))
    return control.run_targets(spark.createDataFrame([("view",), ("click",), ("error",), ("none",)], "target string"), made, "target")


# Chains of a known length on a ring, an acid or an alcohol: the SQL works weights and counts out from the formula.
@query("""WITH k AS (SELECT o_orderkey AS id, 1 + o_custkey % 6 AS n, o_orderkey % 3 AS m FROM orders) SELECT id, round(CASE m WHEN 0 THEN 12.011e0 * n + 1.008e0 * (2 * n + 2) + 15.999e0 WHEN 1 THEN 12.011e0 * (6 + n) + 1.008e0 * (5 + 2 * n + 2) + 14.007e0 ELSE 12.011e0 * (n + 1) + 1.008e0 * (2 * n + 2) + 2 * 15.999e0 END, 3) AS mw,
  CAST(CASE m WHEN 0 THEN n + 1 WHEN 1 THEN 7 + n ELSE n + 3 END AS INTEGER) AS heavy, CAST(CASE m WHEN 1 THEN 1 ELSE 0 END AS INTEGER) AS rings, 1 AS hbd, CAST(CASE m WHEN 2 THEN 2 ELSE 1 END AS INTEGER) AS hba,
  CASE m WHEN 0 THEN 20.23e0 WHEN 1 THEN 26.02e0 ELSE 37.30e0 END AS tpsa, CAST(CASE m WHEN 0 THEN greatest(n - 2, 0) WHEN 1 THEN n ELSE greatest(n - 1, 0) END AS INTEGER) AS rotatable FROM k""")
def q_descriptors(spark, sf):
    line = "concat(CASE o_orderkey % 3 WHEN 1 THEN 'c1ccccc1' ELSE '' END, repeat('C', CAST(1 + o_custkey % 6 AS INTEGER)), CASE o_orderkey % 3 WHEN 0 THEN 'O' WHEN 1 THEN 'N' ELSE 'C(=O)O' END)"
    rows = read(spark, sf, "orders").select(c("o_orderkey").alias("id"), F.expr(line).alias("smiles"))
    return molecules.with_descriptors(rows).select("id", "mw", "heavy", "rings", "hbd", "hba", "tpsa", "rotatable")
