"""Merkle manifest of a dataset, with its nodes in Parquet, and proofs read from it.

Leaves are the sha256 of rows.  They are written as sorted runs (one range of group and order a
task), numbered by the runs' counts, and folded sixteen at a time: each level of the tree is a
table of its own that is made from the one below, a row a run of nodes.  Every group has its
tree, and the groups' roots in their order are the leaves of a last tree, made the same way.

Proofs come from the top down.  A level is joined with the paths of the level above by
coordinate (group and run number), which Spark does by sorting and merging where a level is
large, and each node adds what stands left and right of it in its run.  No level is held by one
task, no group either: a group's runs lie all over the tasks.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reagentql.llm.common import checkpoint_dir, delete

FANOUT = 16


def digest(text: Column) -> Column:
    """Lowercase hex sha256 of a text's UTF-8."""
    return F.sha2(text.cast("binary"), 256)


def leaf_digest(*columns: Column) -> Column:
    """Digest of a row: of each value its byte count, a colon and its text, or a dash for null."""
    parts = [F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")) for c in columns]
    return digest(F.concat(*[F.coalesce(p, F.lit("-")) for p in parts]))


def _joined(digests: Column) -> Column:
    return F.array_join(digests, "")


@dataclass
class Manifest:
    """A stored tree: ``levels`` tables of runs for the groups' trees, ``top`` for the tree over groups.  No root if there are no rows."""

    spark: SparkSession
    folder: str
    root: str | None
    levels: int
    top: int

    def level(self, k: int, tree: str = "groups") -> DataFrame:
        """grp, run, n, kids: the runs of up to FANOUT nodes of a level; n is how many nodes the level has in the group."""
        return self.spark.read.parquet(f"{self.folder}/{tree}/level={k}")

    def delete(self) -> None:
        delete(self.spark, self.folder)


class _Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def put(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")


def _numbered(store: _Store, rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` as sorted runs, with idx (from 0) and n (their number) in each grp.

    A range of rows is a run, and a group of any size is spread over many of them.  The counts of
    a group in each run say where its part of the run begins.
    """
    by = [F.col("grp").asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order]]
    sorted_rows = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    runs = store.put(sorted_rows.withColumns({"__run": F.spark_partition_id(), "__at": place}), f"{name}/sorted")
    counts = runs.groupBy("__run", "grp").agg(F.min("__at").alias("__first"), F.count("*").alias("__k"))
    whole = Window.partitionBy("grp")
    before = F.sum("__k").over(whole.orderBy("__run").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumns({"__before": F.coalesce(before, F.lit(0)), "n": F.sum("__k").over(whole)}).drop("__k")
    counts = store.put(counts, f"{name}/counts")  # Spark sees its size, and broadcasts it if it is small
    out = runs.join(counts, ["__run", "grp"]).withColumn("idx", F.col("__at") - F.col("__first") + F.col("__before"))
    return out.drop("__run", "__at", "__first", "__before")


def _runs(nodes: DataFrame) -> DataFrame:
    """Runs of up to FANOUT consecutive nodes: grp, run, n, kids (in order)."""
    kid = F.struct("idx", "digest", "kept")
    return nodes.groupBy("grp", F.floor(F.col("idx") / FANOUT).alias("run"), "n").agg(F.sort_array(F.collect_list(kid)).alias("kids"))


def _folded(runs: DataFrame) -> DataFrame:
    """The nodes that runs become, the digests of their nodes' digests; a group of one run is at its root and goes no further."""
    more = F.ceil(F.col("n") / FANOUT)
    return runs.where(F.col("n") > FANOUT).select("grp", F.col("run").alias("idx"), more.alias("n"), digest(_joined(F.col("kids.digest"))).alias("digest"), F.lit(None).cast("string").alias("kept"))


def _tree(store: _Store, leaves: DataFrame, order: list[str], tree: str) -> int:
    """Write the levels of every group's tree over its leaves, each from the one below, and return how many there are."""
    nodes = _numbered(store, leaves, order, tree)
    runs = store.put(_runs(nodes), f"{tree}/level=0")
    n = runs.agg(F.max("n")).first()[0] or 0
    levels = 1
    while n > FANOUT:
        runs = store.put(_runs(_folded(runs)), f"{tree}/level={levels}")
        levels, n = levels + 1, -(-n // FANOUT)
    for part in ("sorted", "counts"):
        delete(store.spark, f"{store.folder}/{tree}/{part}")
    return levels


def _tops(manifest: Manifest, tree: str, levels: int) -> DataFrame:
    """grp, level, digest: the root of every group and the level whose one run it is made from."""
    out = None
    for k in range(levels):
        # A lone leaf is its own root; a run of at most FANOUT nodes is the last of its group.
        last = manifest.level(k, tree).where(F.col("n") <= FANOUT)
        own = F.when(F.col("n") == 1, F.col("kids")[0]["digest"]).otherwise(digest(_joined(F.col("kids.digest"))))
        rows = last.select("grp", F.lit(k).alias("level"), own.alias("digest"))
        out = rows if out is None else out.unionByName(rows)
    return out


def write_manifest(docs: DataFrame, leaf: Column, group: Column, order: Column, keep: dict[str, Column] | None = None, folder: str | None = None) -> Manifest:
    """Hash the rows of ``docs`` and write the nodes of all trees to a folder (by default a new one in the checkpoint folder).

    ``group`` is text, and may be null: nulls are a group, the first one; the others go by their
    UTF-8 bytes.  In a group leaves ascend by ``order``, null first, then by their digests, so
    repeated rows are leaves of their own and the tree is the same however rows are dealt.
    ``keep`` names columns that stay with the leaves.  An empty table gives a manifest without a root.
    """
    spark = docs.sparkSession
    folder = folder or f"{checkpoint_dir(spark).rstrip('/')}/manifest-{uuid.uuid4().hex}"
    store = _Store(spark, folder)
    kept = F.struct(*[v.alias(k) for k, v in (keep or {}).items()]) if keep else F.lit(None).cast("string")
    # A null group is the empty text here and others begin with a sign, so that all joins find them.
    grp = F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))
    rows = docs.select(grp.alias("grp"), order.alias("o"), leaf.alias("digest"), kept.alias("kept"), F.monotonically_increasing_id().alias("u"))
    leaves = store.put(rows, "leaves")
    levels = _tree(store, leaves, ["o", "digest", "u"], "groups")
    delete(spark, f"{folder}/leaves")
    manifest = Manifest(spark, folder, None, levels, 0)
    tops = store.put(_tops(manifest, "groups", levels).select(F.lit("").alias("grp"), F.struct("grp", "level", "digest").alias("kept"), "digest", F.col("grp").alias("o")), "tops")
    manifest.top = _tree(store, tops, ["o"], "roots")
    root = _tops(manifest, "roots", manifest.top).first()
    manifest.root = root["digest"] if root else None
    return manifest


PATH = "array<struct<left:string,right:string>>"


def _down(manifest: Manifest, tree: str, levels: int, ends: DataFrame) -> DataFrame:
    """The leaves of trees with their paths to the root.

    ``ends`` has grp, level, path and info: for each group its root's path, and the level whose
    run the root is made from.
    """
    above = None
    for k in reversed(range(levels)):
        here = ends.where(F.col("level") == k).select("grp", F.lit(0).cast("long").alias("run"), "path", "info")
        parents = here if above is None else here.unionByName(above)
        kids = manifest.level(k, tree).join(parents, ["grp", "run"]).select("grp", "n", "kids", "path", "info", F.posexplode("kids").alias("at", "kid"))
        side = lambda start, length: _joined(F.slice(F.col("kids.digest"), start, length))
        step = F.struct(side(F.lit(1), F.col("at")).alias("left"), side(F.col("at") + 2, F.lit(FANOUT)).alias("right"))
        path = F.when(F.col("n") > 1, F.concat(F.array(step), F.col("path"))).otherwise(F.col("path"))
        above = kids.select("grp", F.col("kid.idx").alias("run"), path.alias("path"), "info", "kid")
        if k:
            above = above.drop("kid")
    return above


def proofs(manifest: Manifest) -> DataFrame:
    """Every leaf: the kept columns, leaf, subroot (its group's root), root, and path.

    The path lists for each level, from the leaf's own to the root, the digests left and right of
    the node in its run, each side as one text; a level where the node stands alone has both empty.
    """
    ends = manifest.spark.createDataFrame([("", manifest.top - 1, [], None)], f"grp string, level int, path {PATH}, info string")
    tops = _down(manifest, "roots", manifest.top, ends)
    groups = tops.select(F.col("kid.kept.grp").alias("grp"), F.col("kid.kept.level").alias("level"), "path", F.col("kid.digest").alias("info"))
    leaves = _down(manifest, "groups", manifest.levels, groups)
    kept = ["kid.kept.*"] if manifest.level(0).schema["kids"].dataType.elementType["kept"].dataType.typeName() == "struct" else []
    return leaves.select(*kept, F.col("kid.digest").alias("leaf"), F.col("info").alias("subroot"), F.lit(manifest.root).cast("string").alias("root"), "path")


def proof_digest(path: Column) -> Column:
    """Digest of all digests of a path in order."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a path lead to."""
    return F.aggregate(path, leaf, lambda h, s: digest(F.concat(s["left"], h, s["right"])))
