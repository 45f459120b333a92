"""Order with null groups, chains, long intervals, known keys and sketches over the driver tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reagentql.operators import chains, sketches
from reagentql.operators import relational as R
from reagentql.operators.known import KnownKeys
from reagentql.plans.proxies import read
from reagentql.plans.relational import PAIRS
from reagentql.storage import own_folder

c = F.col
r6 = lambda x: F.round(x, 6)
Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def put(f):
        Q[f.__name__], SQL[f.__name__] = f, sql
        return f

    return put


# Languages, every fifth document without one.
GROUPED = "g AS (SELECT doc_id, CASE WHEN doc_id % 5 > 0 THEN lang END AS g, CASE WHEN doc_id % 7 > 0 THEN CAST(n_chars AS DOUBLE) END AS v FROM documents)"


def _grouped(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.when(c("doc_id") % 5 > 0, c("lang")).alias("g"), F.when(c("doc_id") % 7 > 0, c("n_chars").cast("double")).alias("v"))


@query(f"WITH {GROUPED} SELECT doc_id, coalesce(g, '') || '_' || lpad(CAST(row_number() OVER (PARTITION BY g ORDER BY v NULLS FIRST, doc_id) - 1 AS VARCHAR), 5, '0') AS seq_id FROM g")
def q_seq_ids_of_null_groups(spark, sf):
    return R.sequence_ids(_grouped(spark, sf), "g", "v", [c("doc_id")]).select("doc_id", "seq_id")


@query(f"""WITH {GROUPED}, o AS (SELECT doc_id, g, row_number() OVER (PARTITION BY g ORDER BY md5('42-' || doc_id), doc_id) AS i, count(*) OVER (PARTITION BY g) AS n FROM g)
  SELECT doc_id, g, CASE WHEN i <= floor(n * 0.9e0) THEN 'train' ELSE 'held_out' END AS split FROM o""")
def q_split_of_null_groups(spark, sf):
    return R.split_rows(_grouped(spark, sf).select("doc_id", "g"), "g", "doc_id", (("train", 0.9), ("held_out", 0.1)))


@query(f"WITH {GROUPED} SELECT g, count(*) AS n, count(v) AS n_valid, round(avg(v), 6) AS mean, min(v) AS low, max(v) AS high, round(stddev_pop(v), 6) AS std_pop, round(stddev_samp(v), 6) AS std_samp, count(*) FILTER (v > 500) AS n_high, round(quantile_cont(v, 0.5), 6) AS median FROM g GROUP BY g")
def q_summary_of_null_groups(spark, sf):
    return R.summary(_grouped(spark, sf), "v", ["g"], 500.0)


@query(f"""WITH {GROUPED}, s AS (SELECT g, unnest(range(1, 9)) AS slot FROM (SELECT DISTINCT g FROM g)), r AS (SELECT g, doc_id, row_number() OVER (PARTITION BY g ORDER BY doc_id) AS i FROM g WHERE v > 9000)
  SELECT s.g AS g, CAST(slot AS INTEGER) AS slot, coalesce(doc_id, -1) AS doc_id FROM s LEFT JOIN r ON s.g IS NOT DISTINCT FROM r.g AND i = slot""")
def q_pad_null_groups(spark, sf):
    rows = _grouped(spark, sf)
    return R.pad_rows(rows.where("v > 9000").select("g", "doc_id"), "g", [c("doc_id")], 8, {"doc_id": F.lit(-1)}, rows).select("g", "slot", "doc_id")


# An order's parent is its customer's order before; of every fiftieth customer the first order's is the last, so that all are a cycle.
LINKS = """links AS (SELECT o_custkey AS cust, o_orderkey AS node, CASE WHEN lag(o_orderkey) OVER w IS NULL AND o_custkey % 50 = 0 THEN max(o_orderkey) OVER (PARTITION BY o_custkey) ELSE lag(o_orderkey) OVER w END AS up FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))"""


def _links(spark, sf):
    w = Window.partitionBy("o_custkey")
    before = F.lag("o_orderkey").over(w.orderBy("o_orderkey"))
    up = F.when(before.isNull() & (c("o_custkey") % 50 == 0), F.max("o_orderkey").over(w)).otherwise(before)
    return read(spark, sf, "orders").select(c("o_orderkey").alias("node"), up.alias("up"))


@query(f"""WITH RECURSIVE {LINKS}, r AS (SELECT node, node AS root, CAST(0 AS BIGINT) AS depth FROM links WHERE up IS NULL UNION ALL SELECT l.node, r.root, r.depth + 1 FROM links l JOIN r ON l.up = r.node)
  SELECT node, root, depth, NULL AS cycle FROM r UNION ALL SELECT node, NULL, NULL, min(node) OVER (PARTITION BY cust) FROM links WHERE cust % 50 = 0""")
def q_parent_chain(spark, sf):
    return chains.parent_chains(_links(spark, sf), "node", "up")


@query(f"""WITH RECURSIVE {LINKS}, e AS (SELECT node FROM links WHERE cust % 50 > 0 AND node NOT IN (SELECT up FROM links WHERE up IS NOT NULL)),
  r AS (SELECT e.node, l.node AS ancestor, l.up, 0 AS away FROM e JOIN links l ON l.node = e.node UNION ALL SELECT r.node, l.node, l.up, away + 1 FROM r JOIN links l ON l.node = r.up)
  SELECT node, max(away) OVER (PARTITION BY node) - away AS place, ancestor FROM r""")
def q_chain_paths(spark, sf):
    links = _links(spark, sf)
    ends = links.join(links.select(c("up").alias("node")), "node", "left_anti")
    return chains.chain_paths(links, "node", "up", ends)


# Intervals of one to 10^8 cells.
@query("""WITH i AS (SELECT p_partkey AS part, p_partkey AS low, p_partkey + CAST(pow(10, p_size % 9) AS BIGINT) AS high, p_partkey % 5 AS g FROM part), x AS (SELECT s_suppkey AS supp, s_suppkey * s_suppkey * 7 AS pos, s_suppkey % 5 AS g FROM supplier)
  SELECT supp, count(*) AS n, max(part) AS last_part FROM x JOIN i ON x.g = i.g AND pos BETWEEN low AND high GROUP BY supp""")
def q_long_intervals(spark, sf):
    low = c("p_partkey").cast("long")
    spans = read(spark, sf, "part").select(c("p_partkey").alias("part"), low.alias("low"), (low + F.pow(F.lit(10), c("p_size") % 9).cast("long")).alias("high"), (c("p_partkey") % 5).alias("g"))
    points = read(spark, sf, "supplier").select(c("s_suppkey").alias("supp"), (c("s_suppkey").cast("long") * c("s_suppkey") * 7).alias("at"), (c("s_suppkey") % 5).alias("g"))
    return R.within_intervals(points, spans, "g", "at", "low", "high", 1.0).groupBy("supp").agg(F.count("*").alias("n"), F.max("part").alias("last_part"))


@query(f"SELECT DISTINCT part, supp FROM {PAIRS} n WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND NOT EXISTS (SELECT 1 FROM {PAIRS} o WHERE o.l_shipdate < TIMESTAMP '1997-01-01' AND o.part = n.part AND o.supp = n.supp)")
def q_novelty_indexed(spark, sf):
    """Pairs shipped since 1997 that two earlier runs, kept under a Bloom index, do not know."""
    rows = read(spark, sf, "lineitem").select(c("l_partkey").alias("part"), c("l_suppkey").alias("supp"), F.year("l_shipdate").alias("y"))
    store = KnownKeys(spark, own_folder(spark))
    store.add(1, rows.where("y < 1995"), ["part", "supp"])
    store.add(2, rows.where("y IN (1995, 1996)"), ["part", "supp"])
    return store.novel(rows.where("y >= 1997").select("part", "supp").distinct(), ["part", "supp"])


@query("SELECT event_type AS target, count(*) AS n, count(DISTINCT user_id) AS n_distinct, round(quantile_cont(value, 0.5), 6) AS median, TRUE AS distinct_near, TRUE AS median_near FROM events GROUP BY event_type")
def q_run_sketches(spark, sf):
    """Sketches of each day's events merged, beside the exact figures: distinct users within 5 %, the median's rank within 3 %."""
    e = read(spark, sf, "events").select(c("event_type").alias("target"), F.dayofmonth("ts").alias("day"), "user_id", "value")
    whole = sketches.merged(sketches.run_sketches(e, ["target", "day"], "user_id", "value"), ["target"])
    exact = sketches.exact_report(e, ["target"], "user_id", "value")
    near = sketches.report(whole, ["target"]).select("target", c("n_distinct").alias("about"), c("quantile").alias("middle"))
    below = e.join(F.broadcast(near.select("target", "middle")), "target").groupBy("target").agg(F.avg((c("value") <= c("middle")).cast("double")).alias("share"))
    out = exact.join(near, "target").join(below, "target")
    return out.select(
        "target", "n", "n_distinct", r6(c("quantile")).alias("median"), (F.abs(c("about") - c("n_distinct")) <= 0.05 * c("n_distinct")).alias("distinct_near"), (F.abs(c("share") - 0.5) <= 0.03).alias("median_near")
    )
