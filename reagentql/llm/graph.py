"""Connected components of a link table, by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reagentql.llm.common import cut

#: Parts into which rows that name one large component are dealt while labels are looked up.
SALTS = 32
#: Rows of a table in one partition, at least; small tables are few files.
ROWS = 250_000


def _renamed(rows: DataFrame, column: str, up: DataFrame, salts: int) -> DataFrame:
    """``rows`` with the nodes in ``column`` replaced by their labels in ``up`` (node, label), if they have one."""
    names = rows.columns
    to = up.select(F.col("node").alias(column), F.col("label").alias("__to"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__salt"))
    dealt = rows.withColumn("__salt", F.pmod(F.xxhash64(*names), F.lit(salts)).cast("int"))
    found = dealt.join(to, [column, "__salt"], "left").withColumn(column, F.coalesce("__to", column))
    return found.select(*names)


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node in ``links`` (columns a, b: long).

    Each round hooks every node to its smallest neighbour, follows the hooks to their roots
    and contracts the links to links between roots, so the links left shrink quickly.  All
    states are written to the checkpoint folder.  Links to oneself and repeated links change
    nothing; no links give no rows.
    """
    one = lambda rows: rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    edges, labels, salts = cut(one(links)), None, 1
    # No later table has more rows than twice the links.
    parts = 1 + edges.count() // ROWS
    keep = lambda rows: cut(rows.coalesce(parts))
    while True:
        both = edges.select(F.col("a").alias("node"), "b").union(edges.select(F.col("b").alias("node"), F.col("a").alias("b")))
        up = keep(both.groupBy("node").agg(F.least(F.min("b"), F.first("node")).alias("label")))
        while True:
            # Only nodes that others name are looked up, so their salted copies are few.
            named = up.select(F.col("label").alias("node")).distinct()
            named = up.join(named, "node", "left_semi").where("label < node")
            if named.isEmpty():
                break
            up = keep(_renamed(up, "label", named, SALTS))
        labels = up if labels is None else keep(_renamed(labels, "label", up, salts))
        edges = keep(one(_renamed(_renamed(edges, "a", up, salts), "b", up, salts)))
        if edges.isEmpty():
            return labels.select("node", F.col("label").alias("component"))
        salts = SALTS
