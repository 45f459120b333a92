"""Operators over vectors, sets and points: rank correlation, set similarity, radius joins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reagentql.functions.scoring import distance, fisher_z


def average_ranks(df: DataFrame, group: str, value: str, out: str) -> DataFrame:
    """Ranks within a group, ties sharing their mean rank."""
    order = Window.partitionBy(group).orderBy(value)
    ties = F.count("*").over(Window.partitionBy(group, value))
    return df.withColumn(out, F.rank().over(order) + (ties - 1) / 2.0)


def spearman_to_signature(cells: DataFrame, signature: DataFrame) -> DataFrame:
    """cell, rho, z of every cell's values against a signature over the genes of both.

    ``cells`` has cell, gene, value; ``signature`` gene, weight (a dimension of one row per
    gene).  A constant side gives rho 0; rho is clipped before Fisher's transform.
    """
    common = cells.join(F.broadcast(signature), "gene")
    ranked = average_ranks(average_ranks(common, "cell", "value", "rv"), "cell", "weight", "rw")
    r = F.try_divide(F.covar_samp("rv", "rw"), F.stddev_samp("rv") * F.stddev_samp("rw"))
    rho = ranked.groupBy("cell").agg(F.coalesce(r, F.lit(0.0)).alias("rho"))
    # Adding zero turns a negative zero into zero.
    return rho.select("cell", (F.round("rho", 6) + 0.0).alias("rho"), (F.round(fisher_z(F.col("rho")), 5) + 0.0).alias("z"))


#: Sets and tokens of a block, and counters that a task holds at a time.
BLOCK_SETS, BLOCK_TOKENS, MATCHED = 4096, 1 << 20, 1 << 22


def _set_blocks(sets: DataFrame, name: str, block: int) -> tuple[DataFrame, int]:
    """Sets packed by hash of their id into blocks of about ``block`` sets and BLOCK_TOKENS tokens, and how many blocks there are."""
    count, tokens = sets.agg(F.count("*"), F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()
    n = max(1, -(-count // block), -(-tokens // BLOCK_TOKENS))
    part = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias(name)
    return sets.groupBy(part).agg(F.collect_list(F.struct("id", "tokens")).alias(f"{name}_sets")), n


def _best_of_block(sets: pa.Array, references: pa.Array) -> np.ndarray:
    """The highest Tanimoto similarity of each token list to any of the references'."""
    known = references.flatten().unique()
    of = pc.index_in(references.flatten(), value_set=known).to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(references.offsets.to_numpy())
    order = np.argsort(of, kind="stable")
    holders = np.repeat(np.arange(len(sizes)), sizes)[order]  # references by the tokens they hold
    first = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(known)))]).astype(np.int64)
    best, step = [], max(1, MATCHED // max(1, len(sizes)))
    for at in range(0, len(sets), step):
        part = sets.slice(at, step)
        mine = np.diff(part.offsets.to_numpy())
        place = pc.index_in(part.flatten(), value_set=known)
        hit = np.flatnonzero(place.is_valid().to_numpy(zero_copy_only=False))
        which = place.take(pa.array(hit)).to_numpy().astype(np.int64)
        times = first[which + 1] - first[which]
        row = np.repeat(np.repeat(np.arange(len(mine)), mine)[hit], times)
        there = np.repeat(first[which], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        both = np.bincount(row * len(sizes) + holders[there], minlength=len(mine) * len(sizes)).reshape(len(mine), len(sizes))
        union = sizes[None, :] + mine[:, None] - both
        best.append(np.where(union > 0, both / np.maximum(union, 1), 0.0).max(1, initial=0.0))
    return np.concatenate(best) if best else np.zeros(0)


def best_set_match(sets: DataFrame, references: DataFrame, block: int = BLOCK_SETS) -> DataFrame:
    """id, best: the highest Tanimoto similarity of each token set (id, tokens) to any reference set; repeated ids give one row, their best.

    Both sides are packed into blocks of bounded size, and each pair of blocks is a row of a join
    whose keys are unique on both sides, so the driver holds nothing and no pair is hot.  In a pair
    the references' tokens list the sets that hold them, and every set adds up its tokens' lists.
    """
    distinct = lambda df: df.select("id", F.array_distinct(F.coalesce("tokens", F.array().cast("array<string>"))).alias("tokens"))
    kind = sets.schema["id"].dataType.simpleString()
    sets, references = distinct(sets), distinct(references)
    mine, nm = _set_blocks(sets, "m", block)
    theirs, nt = _set_blocks(references, "t", block)
    pairs = mine.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(nt - 1)))).join(theirs.withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(nm - 1)))), ["m", "t"])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = (batch.column(n)[i].values for n in ("m_sets", "t_sets"))
                yield pa.RecordBatch.from_arrays([a.field("id"), pa.array(_best_of_block(a.field("tokens"), b.field("tokens")), pa.float64())], ["id", "best"])

    found = pairs.select("m_sets", "t_sets").mapInArrow(run, f"id {kind}, best double")
    # Without references there is no pair, and the best is zero.
    every = sets.select("id", F.lit(0.0).alias("best"))
    return every.unionByName(found).groupBy("id").agg(F.round(F.max("best"), 6).alias("best"))


def within_radius(points: DataFrame, centres: DataFrame, radius: float, by: list[str] = ()) -> DataFrame:
    """Pairs of a point (pid, x, y, z) and a centre (cid, x, y, z) closer than the radius, with their distance.

    Only points and centres with equal ``by`` columns are compared.

    Both sides meet in grid cells as wide as the radius; centres are copied to the 27 cells
    around them, so only neighbours are compared.
    """
    cell = lambda c: F.floor(F.col(c) / radius).cast("long")
    near = F.sequence(F.lit(-1), F.lit(1))
    p = points.select("pid", *by, *[F.col(c).alias(f"p{c}") for c in "xyz"], *[cell(c).alias(f"g{c}") for c in "xyz"])
    c = centres.select("cid", *by, *[F.col(c).alias(f"c{c}") for c in "xyz"], *[cell(c).alias(f"h{c}") for c in "xyz"])
    for axis in "xyz":
        c = c.withColumn("__d", F.explode(near)).withColumn(f"g{axis}", F.col(f"h{axis}") + F.col("__d")).drop("__d")
    d = distance(*[F.col(f"{s}{a}") for s in "pc" for a in "xyz"])
    return p.join(c, [*by, "gx", "gy", "gz"]).withColumn("d", d).where(F.col("d") < radius).select("cid", "pid", "d")
