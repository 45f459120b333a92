"""Joins, windows, sets, reshaping and sampling over the driver tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from reagentql.operators import relational as R
from reagentql.operators import structure as P
from reagentql.operators import vectors as V
from reagentql.plans.proxies import read

c = F.col
r6 = lambda x: F.round(x, 6)
Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def put(f):
        Q[f.__name__], SQL[f.__name__] = f, sql
        return f

    return put


def attempts(spark, sf):
    """events as attempts: type is the target, day the attempt, user the key."""
    return read(spark, sf, "events").select(
        c("event_type").alias("target"), F.dayofmonth("ts").alias("attempt"), c("user_id").alias("key"), c("event_id").alias("pos"), "value"
    )


ATTEMPT = "a AS (SELECT event_type AS target, CAST(day(ts) AS INTEGER) AS attempt, user_id AS key, event_id AS pos, value FROM events)"
PAIRS = "(SELECT l_partkey AS part, l_suppkey AS supp, l_shipdate FROM lineitem)"


def _pairs(spark, sf):
    return read(spark, sf, "lineitem").select(c("l_partkey").alias("part"), c("l_suppkey").alias("supp"), "l_shipdate")


@query(f"SELECT DISTINCT part, supp FROM {PAIRS} n WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND NOT EXISTS (SELECT 1 FROM {PAIRS} o WHERE o.l_shipdate < TIMESTAMP '1997-01-01' AND o.part = n.part AND o.supp = n.supp)")
def q_novelty_anti(spark, sf):
    rows, then = _pairs(spark, sf), F.lit("1997-01-01").cast("timestamp")
    return R.novel(rows.where(c("l_shipdate") >= then).select("part", "supp").distinct(), rows.where(c("l_shipdate") < then), ["part", "supp"])


@query(f"SELECT DISTINCT part, supp FROM {PAIRS} n WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND EXISTS (SELECT 1 FROM {PAIRS} o WHERE o.l_shipdate < TIMESTAMP '1997-01-01' AND o.part = n.part AND o.supp = n.supp)")
def q_dup_semi(spark, sf):
    rows, then = _pairs(spark, sf), F.lit("1997-01-01").cast("timestamp")
    return R.already_known(rows.where(c("l_shipdate") >= then).select("part", "supp").distinct(), rows.where(c("l_shipdate") < then), ["part", "supp"])


@query(f"WITH {ATTEMPT} SELECT target, key, attempt, pos FROM (SELECT *, row_number() OVER (PARTITION BY target, key ORDER BY attempt, pos) AS n FROM a) WHERE n = 1")
def q_first_seen(spark, sf):
    return R.first_seen(attempts(spark, sf), ["target", "key"], [c("attempt"), c("pos")]).select("target", "key", "attempt", "pos")


@query(f"""WITH {ATTEMPT}, m AS (SELECT *, row_number() OVER (PARTITION BY target, key ORDER BY attempt, pos) = 1 AS new FROM a),
  p AS (SELECT target, attempt, count(*) FILTER (new) AS new FROM m GROUP BY ALL), t AS (SELECT *, CAST(sum(new) OVER (PARTITION BY target ORDER BY attempt) AS BIGINT) AS total, sum(CAST(new > 0 AS INT)) OVER (PARTITION BY target ORDER BY attempt) AS i FROM p),
  d AS (SELECT *, CAST(CASE WHEN new > 0 THEN 0 ELSE count(*) OVER (PARTITION BY target, i ORDER BY attempt) - CAST(i > 0 AS INT) END AS BIGINT) AS dry FROM t)
  SELECT target, attempt, new, total, dry, dry >= 3 OR total >= 300 AS stop FROM d""")
def q_attempt_streaks(spark, sf):
    return R.attempt_streaks(attempts(spark, sf), "target", "attempt", "key", "pos", 3, 300)


@query(f"WITH {ATTEMPT} SELECT pos, target || '_' || lpad(CAST(row_number() OVER (PARTITION BY target ORDER BY pos) - 1 AS VARCHAR), 5, '0') AS seq_id FROM a")
def q_seq_ids(spark, sf):
    return R.sequence_ids(attempts(spark, sf), "target", "pos").select("pos", "seq_id")


@query("""WITH w AS (SELECT event_type, user_id % 8 AS k, avg(value) AS v FROM events GROUP BY ALL), p AS (SELECT *, CASE event_type WHEN 'view' THEN 'high' WHEN 'signup' THEN 'moderate' ELSE 'low' END AS profile FROM w)
  SELECT event_type, 'k' || k AS bucket, round(v, 6) AS score, profile FROM p WHERE v >= 50""")
def q_unpivot_threshold(spark, sf):
    buckets = read(spark, sf, "events").withColumn("b", F.concat(F.lit("k"), (c("user_id") % 8).cast("string")))
    wide = buckets.groupBy("event_type").pivot("b", [f"k{i}" for i in range(8)]).agg(F.avg("value"))
    long = R.unpivot_above(wide, ["event_type"], [f"k{i}" for i in range(8)], "bucket", "score", 50.0)
    profiles = spark.createDataFrame([("view", "high"), ("signup", "moderate")], "event_type string, p string")
    return long.join(F.broadcast(profiles), "event_type", "left").select("event_type", "bucket", r6(c("score")).alias("score"), F.coalesce("p", F.lit("low")).alias("profile"))


@query("""WITH o AS (SELECT doc_id, lang, row_number() OVER w AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents WINDOW w AS (PARTITION BY lang ORDER BY md5('42-' || doc_id), doc_id))
  SELECT doc_id, lang, CASE WHEN i <= floor(n * 0.8e0) THEN 'train' WHEN i <= floor(n * 0.8e0) + floor(n * 0.1e0) THEN 'valid' ELSE 'test' END AS split FROM o""")
def q_stratified_split(spark, sf):
    return R.split_rows(read(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id")


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('42-' || doc_id), doc_id) AS n FROM documents) WHERE n <= 7")
def q_stratified_sample(spark, sf):
    return R.stratified_sample(read(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id", 7)


@query("""WITH u AS (SELECT o_orderkey AS id, CAST('0x' || substr(md5('42-' || o_orderkey), 1, 8) AS BIGINT) / 4294967296e0 AS u FROM orders)
  SELECT CASE WHEN u < 0.25 THEN 'EGFR' WHEN u < 0.45 THEN 'VEGF_VEGFR' WHEN u < 0.6 THEN 'IDH1_IDH2' WHEN u < 0.75 THEN 'MGMT' WHEN u < 0.85 THEN 'GBM_Stem_Cells' WHEN u < 0.93 THEN 'PD1_PDL1' WHEN u < 0.98 THEN 'PI3K_AKT_mTOR' ELSE 'p53_MDM2' END AS target, count(*) AS n FROM u GROUP BY 1""")
def q_weighted_pick(spark, sf):
    # Target weights.
    weights = {"EGFR": 0.25, "VEGF_VEGFR": 0.20, "IDH1_IDH2": 0.15, "MGMT": 0.15, "GBM_Stem_Cells": 0.10, "PD1_PDL1": 0.08, "PI3K_AKT_mTOR": 0.05, "p53_MDM2": 0.02}
    return R.weighted_pick(read(spark, sf, "orders"), "o_orderkey", weights, "target").groupBy("target").agg(F.count("*").alias("n"))


@query("SELECT n_name, r_name, s_suppkey, k FROM (SELECT n_name, r_name, s_suppkey, row_number() OVER (PARTITION BY n_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS k FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) WHERE k <= 5")
def q_kb_lookup(spark, sf):
    nations = read(spark, sf, "nation").join(F.broadcast(read(spark, sf, "region")), c("n_regionkey") == c("r_regionkey"))
    rows = read(spark, sf, "supplier").join(F.broadcast(nations), c("s_nationkey") == c("n_nationkey"))
    return R.top_per_group(rows, ["n_nationkey"], [F.desc("s_acctbal"), c("s_suppkey")], 5, "k").select("n_name", "r_name", "s_suppkey", "k")


@query("""WITH u AS (SELECT c_nationkey AS k, c_name AS name, c_acctbal AS bal, 0 AS src, c_custkey AS pos FROM customer UNION ALL SELECT s_nationkey, s_name, s_acctbal, 1, s_suppkey FROM supplier)
  SELECT k, name, bal FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY src DESC, pos DESC) AS n FROM u) WHERE n = 1""")
def q_union_keep_last(spark, sf):
    a = read(spark, sf, "customer").select(c("c_nationkey").alias("k"), c("c_name").alias("name"), c("c_acctbal").alias("bal"), F.lit(0).alias("src"), c("c_custkey").alias("pos"))
    b = read(spark, sf, "supplier").select(c("s_nationkey").alias("k"), c("s_name").alias("name"), c("s_acctbal").alias("bal"), F.lit(1).alias("src"), c("s_suppkey").alias("pos"))
    return R.keep_last(a.unionByName(b), ["k"], [c("src"), c("pos")]).select("k", "name", "bal")


@query("""WITH l1 AS (SELECT r_regionkey AS node, CAST(r_regionkey AS VARCHAR) AS path FROM (SELECT *, row_number() OVER (ORDER BY r_name, r_regionkey) AS n FROM region) WHERE n <= 3),
  l2 AS (SELECT node, path FROM (SELECT n_nationkey AS node, path || '>' || n_nationkey AS path, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name, n_nationkey) AS n FROM nation JOIN l1 ON n_regionkey = l1.node) WHERE n <= 3),
  l3 AS (SELECT node, path FROM (SELECT s_suppkey AS node, path || '>' || s_suppkey AS path, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS n FROM supplier JOIN l2 ON s_nationkey = l2.node) WHERE n <= 3) SELECT node, path FROM l3""")
def q_beam3(spark, sf):
    order = ["rank_key", "node"]
    table = lambda name, parent, node, key: read(spark, sf, name).select(parent.cast("long").alias("parent"), c(node).cast("long").alias("node"), key.alias("rank_key"))
    levels = [table("region", F.lit(None), "r_regionkey", c("r_name")), table("nation", c("n_regionkey"), "n_nationkey", c("n_name"))]
    levels.append(table("supplier", c("s_nationkey"), "s_suppkey", -c("s_acctbal")))
    return R.beam(levels, "parent", "node", [c(x) for x in order], 3).select("node", F.array_join("path", ">").alias("path"))


@query("SELECT event_type, CAST(epoch(time_bucket(INTERVAL '6 hours', ts)) AS BIGINT) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def q_windows_tumbling(spark, sf):
    w = read(spark, sf, "events").groupBy("event_type", F.window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select("event_type", F.unix_timestamp(c("w.start").cast("timestamp")).alias("start"), "n", "total")


@query("""WITH l AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '12 hours' THEN 0 ELSE 1 END AS b, event_id FROM events),
  s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM l) SELECT user_id, CAST(epoch_us(min(ts)) AS BIGINT) AS start_us, count(*) AS n FROM s GROUP BY user_id, k""")
def q_sessions(spark, sf):
    w = read(spark, sf, "events").groupBy("user_id", F.session_window("ts", "12 hours").alias("w")).agg(F.count("*").alias("n"))
    return w.select("user_id", F.unix_micros(c("w.start").cast("timestamp")).alias("start_us"), "n")


@query("""WITH t AS (SELECT DISTINCT event_type FROM events), s AS (SELECT event_type, unnest(range(1, 6)) AS slot FROM t), r AS (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events WHERE value > 400)
  SELECT s.event_type, CAST(slot AS INTEGER) AS slot, coalesce(event_id, -1) AS event_id, coalesce(value, 0) AS value FROM s LEFT JOIN r ON r.event_type = s.event_type AND n = slot""")
def q_pad_rows(spark, sf):
    rows = read(spark, sf, "events").select("event_type", "event_id", "value")
    return R.pad_rows(rows.where(c("value") > 400), "event_type", [c("event_id")], 5, {"event_id": F.lit(-1), "value": F.lit(0.0)}, rows)


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def q_props_json(spark, sf):
    parsed = read(spark, sf, "events").withColumn("p", F.from_json("props", "k int"))
    return parsed.groupBy("event_type", c("p.k").alias("k")).agg(F.count("*").alias("n"), r6(F.avg("value")).alias("mean"))


# Residue classes.
CLASSES = {
    "hydrophobic": ("ALA", "VAL", "LEU", "ILE", "MET", "PHE", "TRP", "PRO"),
    "polar": ("SER", "THR", "ASN", "GLN"),
    "donor": ("SER", "THR", "TYR", "CYS", "LYS", "ARG", "HIS", "TRP"),
    "acceptor": ("SER", "THR", "TYR", "ASN", "GLN", "ASP", "GLU", "CYS"),
    "aromatic": ("PHE", "TYR", "TRP", "HIS"),
    "positive": ("LYS", "ARG", "HIS"),
    "negative": ("ASP", "GLU"),
}
RESIDUES = ("ALA", "ARG", "ASN", "ASP", "CYS", "GLN", "GLU", "GLY", "HIS", "ILE", "LEU", "LYS", "MET", "PHE", "PRO", "SER", "THR", "TRP", "TYR", "VAL")
LETTERS = "ARNDCQEGHILKMFPSTWYV"
RES_SQL = "x AS (SELECT l_suppkey AS site, l_partkey AS num, " + str(list(RESIDUES)) + "[1 + l_partkey % 20] AS aa FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem))"
COUNTS = ", ".join(f"count(*) FILTER (aa IN {v}) AS n_{k}" for k, v in CLASSES.items())


def residues(spark, sf):
    rows = read(spark, sf, "lineitem").select(c("l_suppkey").alias("site"), c("l_partkey").alias("num")).distinct()
    return rows.withColumn("aa", F.element_at(F.array(*map(F.lit, RESIDUES)), (c("num") % 20 + 1).cast("int")))


@query(f"WITH {RES_SQL}, k AS (SELECT site, {COUNTS} FROM x GROUP BY site) SELECT *, round(coalesce((n_polar + n_donor + n_acceptor) / nullif({' + '.join(f'n_{k}' for k in CLASSES)}, 0), 0), 6) AS polarity FROM k")
def q_residue_classes(spark, sf):
    k = residues(spark, sf).groupBy("site").agg(*[F.count_if(c("aa").isin(*v)).alias(f"n_{n}") for n, v in CLASSES.items()])
    return k.withColumn("polarity", r6(F.coalesce(F.try_divide(c("n_polar") + c("n_donor") + c("n_acceptor"), sum((c(f"n_{n}") for n in CLASSES), F.lit(0))), F.lit(0.0))))


@query(f"WITH {RES_SQL} SELECT site, string_agg(substr('{LETTERS}', CAST(1 + num % 20 AS INTEGER), 1), '' ORDER BY num) AS sequence, coalesce(string_agg(aa || num, ',' ORDER BY num) FILTER (aa IN {CLASSES['aromatic']}), '') AS aromatic FROM x GROUP BY site")
def q_sequences(spark, sf):
    codes = F.create_map(*[F.lit(x) for pair in zip(RESIDUES, LETTERS) for x in pair])
    g = residues(spark, sf).groupBy("site").agg(F.array_sort(F.collect_list(F.struct("num", "aa"))).alias("r"))
    letters = F.array_join(F.transform("r", lambda x: F.coalesce(F.try_element_at(codes, x["aa"]), F.lit("X"))), "")
    arom = F.filter("r", lambda x: x["aa"].isin(*CLASSES["aromatic"]))
    return g.select("site", letters.alias("sequence"), F.array_join(F.transform(arom, lambda x: F.concat(x["aa"], x["num"].cast("string"))), ",").alias("aromatic"))


# Element weights.
WEIGHTS = {"C": 12.01, "N": 14.01, "O": 16.00, "S": 32.07, "H": 1.008, "P": 30.97, "F": 19.00, "CL": 35.45, "BR": 79.90, "I": 126.90}


@query("WITH w AS (SELECT * FROM (VALUES " + ", ".join(f"('{e}', {w}e0)" for e, w in WEIGHTS.items()) + ") t(e, w)) SELECT l_suppkey AS ligand, round(sum(coalesce(w, 12.01e0)), 4) AS mass FROM (SELECT l_suppkey, ['C','N','O','S','H','P','F','CL','BR','I','ZZ'][1 + l_partkey % 11] AS e FROM lineitem) LEFT JOIN w USING (e) GROUP BY l_suppkey")
def q_mass_estimate(spark, sf):
    names = [*WEIGHTS, "ZZ"]
    atoms = read(spark, sf, "lineitem").select(c("l_suppkey").alias("ligand"), F.element_at(F.array(*map(F.lit, names)), (c("l_partkey") % 11 + 1).cast("int")).alias("e"))
    table = spark.createDataFrame(list(WEIGHTS.items()), "e string, w double")
    return atoms.join(F.broadcast(table), "e", "left").groupBy("ligand").agg(F.round(F.sum(F.coalesce("w", F.lit(12.01))), 4).alias("mass"))


# --- vectors


@query("""WITH g AS (SELECT vec_id AS cell, unnest(range(64)) AS gene, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), s AS (SELECT gene, v AS w FROM g WHERE cell = 0), j AS (SELECT cell, v, w FROM g JOIN s USING (gene)),
  r AS (SELECT cell, rank() OVER (PARTITION BY cell ORDER BY v) + (count(*) OVER (PARTITION BY cell, v) - 1) / 2e0 AS rv, rank() OVER (PARTITION BY cell ORDER BY w) + (count(*) OVER (PARTITION BY cell, w) - 1) / 2e0 AS rw FROM j),
  p AS (SELECT cell, corr(rv, rw) AS rho FROM r GROUP BY cell), q AS (SELECT cell, rho, greatest(-0.999999e0, least(0.999999e0, rho)) AS c FROM p) SELECT cell, round(rho, 6) + 0e0 AS rho, round(0.5e0 * ln((1 + c) / (1 - c)), 5) + 0e0 AS z FROM q""")
def q_spearman_fisher(spark, sf):
    cells = read(spark, sf, "embeddings").select(c("vec_id").alias("cell"), F.posexplode("embedding").alias("gene", "v")).select("cell", "gene", c("v").cast("double").alias("value"))
    return V.spearman_to_signature(cells, cells.where(c("cell") == 0).select("gene", c("value").alias("weight")))


WORDS = "list_distinct(list_filter(string_split_regex(lower({0}), '[^a-z]+'), lambda w: len(w) > 3))"


@query(f"""WITH d AS (SELECT doc_id AS id, {WORDS.format('text')} AS t FROM documents), b AS (SELECT item_id AS ref, {WORDS.format('text')} AS t FROM benchmark), e AS (SELECT id, len(t) AS n, unnest(t) AS w FROM d), f AS (SELECT ref, len(t) AS m, unnest(t) AS w FROM b),
  s AS (SELECT id, ref, n, m, count(*) AS k FROM e JOIN f USING (w) GROUP BY ALL), x AS (SELECT id, max(k / CAST(n + m - k AS DOUBLE)) AS best FROM s GROUP BY id) SELECT d.id, round(coalesce(best, 0), 6) AS best FROM d LEFT JOIN x USING (id)""")
def q_tanimoto_max(spark, sf):
    words = lambda t: F.array_distinct(F.filter(F.split(F.lower(t), "[^a-z]+"), lambda w: F.length(w) > 3))
    docs = read(spark, sf, "documents").select(c("doc_id").alias("id"), words(c("text")).alias("tokens"))
    return V.best_set_match(docs, read(spark, sf, "benchmark").select(c("item_id").alias("id"), words(c("text")).alias("tokens")))


POINTS = "p AS (SELECT vec_id AS pid, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings), k AS (SELECT label AS cid, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM p GROUP BY label), n AS (SELECT cid, pid, sqrt((p.x-k.x)*(p.x-k.x) + (p.y-k.y)*(p.y-k.y) + (p.z-k.z)*(p.z-k.z)) AS d FROM p, k)"


@query(f"WITH {POINTS} SELECT cid, count(*) AS n, round(quantile_cont(d, 0.75), 6) AS radius, round(4e0/3 * pi() * pow(quantile_cont(d, 0.75), 3), 6) AS volume, round(avg(d), 6) AS mean FROM n WHERE d < 0.12 GROUP BY cid")
def q_radius_residues(spark, sf):
    e = read(spark, sf, "embeddings")
    p = e.select(c("vec_id").alias("pid"), "label", *[c("embedding")[i].cast("double").alias(a) for i, a in enumerate("xyz")])
    centres = p.groupBy(c("label").alias("cid")).agg(*[F.avg(a).alias(a) for a in "xyz"])
    near = V.within_radius(p, centres, 0.12)
    size = P.pocket_radius(near).select("cid", r6(c("radius")).alias("radius"), r6(c("volume")).alias("volume"))
    return near.groupBy("cid").agg(F.count("*").alias("n"), r6(F.avg("d")).alias("mean")).join(size, "cid")
