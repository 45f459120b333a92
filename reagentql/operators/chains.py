"""Parent chains of any depth by pointer doubling.

A table of links is squared again and again: after r rounds every node knows its ancestor 2^r
steps up, or its root.  A chain of n nodes takes about log2(n) joins, whatever its shape, and
nodes that have reached their root take no further part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reagentql.storage import spilled


def _links(links: DataFrame, node: str, parent: str) -> DataFrame:
    """node, up: each node once, with its parent; a parent that is no node counts as none."""
    one = links.where(F.col(node).isNotNull()).groupBy(F.col(node).alias("node")).agg(F.min(parent).alias("up"))
    there = one.select(F.col("node").alias("up"), F.lit(True).alias("__is"))
    return one.join(there, "up", "left").select("node", F.when(F.col("__is"), F.col("up")).alias("up"))


def _walks(links: DataFrame, node: str, parent: str) -> list[DataFrame]:
    """The state after each round: every node's walk of up to 2^r steps.

    A state has node, top (the root, or where the walk stands), depth (steps to it), least (the
    smallest node passed, itself included) and open (whether the walk has not ended).
    """
    first = spilled(_links(links, node, parent))
    n = first.count()
    top = F.coalesce("up", "node")
    state = first.select("node", top.alias("top"), F.col("up").isNotNull().cast("long").alias("depth"), F.least("node", top).alias("least"), F.col("up").isNotNull().alias("open"))
    # A parent that has none is a root, so its children have arrived.
    roots = first.where("up IS NULL").select(F.col("node").alias("top"), F.lit(True).alias("__root"))
    states = [spilled(state.join(roots, "top", "left").select(*state.columns[:-1], (F.col("open") & F.col("__root").isNull()).alias("open")))]
    while 1 << (len(states) - 1) <= n and not states[-1].where("open").isEmpty():
        state = states[-1]
        ahead = state.select(F.col("node").alias("top"), *[F.col(x).alias(f"__{x}") for x in ("top", "depth", "least", "open")])
        moved = state.where("open").join(ahead, "top").select(
            "node", F.col("__top").alias("top"), (F.col("depth") + F.col("__depth")).alias("depth"), F.least("least", "__least").alias("least"), F.col("__open").alias("open")
        )
        states.append(spilled(state.where("not open").unionByName(moved)))
    return states


def parent_chains(links: DataFrame, node: str, parent: str) -> DataFrame:
    """node, root, depth (steps to the root), cycle (null, or the smallest node of the cycle that the chain runs into).

    A node without a parent, or whose parent is no node of the table, is its own root at depth 0.
    Of repeated nodes the smallest parent counts.  A chain that ends in a cycle has neither root
    nor depth.  Rows without a node take no part.
    """
    state = _walks(links, node, parent)[-1]
    # What is open after log2(n) rounds stands on a cycle, and has passed all of it.
    on = state.select(F.col("node").alias("top"), F.col("least").alias("__cycle"))
    closed = state.where("not open").select("node", F.col("top").alias("root"), "depth", F.lit(None).cast(state.schema["node"].dataType).alias("cycle"))
    opened = state.where("open").join(on, "top").select("node", F.lit(None).cast(state.schema["node"].dataType).alias("root"), F.lit(None).cast("long").alias("depth"), F.col("__cycle").alias("cycle"))
    return closed.unionByName(opened)


def chain_paths(links: DataFrame, node: str, parent: str, of: DataFrame) -> DataFrame:
    """node, place, ancestor: the chains of the nodes of ``of`` from the root (place 0) down to themselves.

    Every place is reached by the jumps of its distance's binary digits, so the work grows with
    the rows returned.  Nodes that run into a cycle have no path.
    """
    states = _walks(links, node, parent)
    state = states[-1]
    asked = of.select(F.col(node).alias("node")).distinct()
    rows = state.where("not open").join(asked, "node").select("node", "depth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("depth"))).alias("away"), F.col("node").alias("at"))
    for k, walked in enumerate(states):
        bit = F.call_function("shiftright", F.col("away"), F.lit(k)).bitwiseAND(F.lit(1)) == 1
        ahead = walked.where(F.col("depth") == 1 << k).select(F.col("node").alias("__node"), F.col("top").alias("up"))
        rows = rows.join(ahead, (F.col("at") == F.col("__node")) & bit, "left").select("node", "depth", "away", F.when(bit, F.col("up")).otherwise(F.col("at")).alias("at"))
    return rows.select("node", (F.col("depth") - F.col("away")).alias("place"), F.col("at").alias("ancestor"))
