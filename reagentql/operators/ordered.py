"""Operators over rows in order, for groups of any size.

Rows are dealt by ranges of (group, order) and sorted within them, so a group lies over as many
tasks as it needs and equal values do not meet in one.  The sorted ranges, here called runs, are
written once; what a row needs from the rows before it comes from its own run and from a small
table with one row per run and group.  A null group is a group like any other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reagentql.storage import spilled


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on equal keys where null equals null; the keys and the other columns of both sides."""
    if not keys:
        return left.join(F.broadcast(right), F.lit(True), how)  # one row without keys
    renamed = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__right_{k}")) for k in keys])
    return left.join(renamed, on, how).drop(*[f"__right_{k}" for k in keys])


def sorted_runs(df: DataFrame, groups: list[str], order: list[Column]) -> DataFrame:
    """``df`` with __run and __at: the run of each row, and its place in it; runs rise with group and order.

    Rows equal in all of these are told apart by their place in ``df``, so not even they meet in one run.
    """
    keys = [F.col(g).asc_nulls_first() for g in groups] + list(order) + [F.col("__place").asc()]
    rows = df.withColumn("__place", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return spilled(rows.drop("__place").withColumns({"__run": F.spark_partition_id(), "__at": at}))


def _by(groups: list[str]) -> list:
    return list(groups) or [F.lit(0)]


def _before_run(groups: list[str]):
    """All earlier runs of a group; a group has one row a run here, however many it holds."""
    return Window.partitionBy(*_by(groups)).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)


def numbered(df: DataFrame, groups: list[str], value: str, ties: list[Column], out: str, total: str | None = None) -> DataFrame:
    """Rows numbered from 0 within each group by a column (its nulls first), then ``ties``; ``total`` names a column for the group's size."""
    runs = sorted_runs(df, groups, [F.col(value).asc_nulls_first(), *ties])
    counts = runs.groupBy("__run", *groups).agg(F.min("__at").alias("__first"), F.count("*").alias("__k"))
    more = {"__before": F.coalesce(F.sum("__k").over(_before_run(groups)), F.lit(0))}
    if total:
        more[total] = F.sum("__k").over(Window.partitionBy(*_by(groups)))
    counts = counts.withColumns(more).drop("__k")
    rows = null_safe_join(runs, counts, ["__run", *groups])
    return rows.withColumn(out, F.col("__before") + F.col("__at") - F.col("__first")).drop("__run", "__at", "__first", "__before")


def exact_quantile(df: DataFrame, by: list[str], value: str, share: float, out: str) -> DataFrame:
    """The exact quantile (interpolated) of a column per group; null for a group without values.

    Null and NaN are no values.  Equal values are counted before anything is sorted, so a frequent
    one is a single row, and only the runs that hold the quantile's two neighbours are looked into.
    """
    x = F.nullif(F.col(value), F.lit(float("nan"))) if dict(df.dtypes)[value] in ("double", "float") else F.col(value)
    counts = df.groupBy(*by, x.alias("__v")).agg(F.count("*").alias("__k"))
    runs = sorted_runs(counts.withColumn("__k", F.when(F.col("__v").isNotNull(), F.col("__k")).otherwise(0)), by, [F.col("__v").asc_nulls_first()])
    per = runs.groupBy("__run", *by).agg(F.sum("__k").alias("__s"))
    per = per.withColumns({"__before": F.coalesce(F.sum("__s").over(_before_run(by)), F.lit(0)), "__n": F.sum("__s").over(Window.partitionBy(*_by(by)))})
    place = (F.col("__n") - 1) * F.lit(share)
    per = per.withColumns({"__low": F.floor(place), "__high": F.ceil(place), "__part": place - F.floor(place)})
    # A group without values keeps one row, of nulls.
    held = (F.col("__before") <= F.col("__high")) & (F.col("__before") + F.col("__s") > F.col("__low"))
    needed = per.where(held | (F.col("__n") == 0)).drop("__s", "__n")
    rows = null_safe_join(runs.drop("__at"), needed, ["__run", *by])
    upto = F.col("__before") + F.sum("__k").over(Window.partitionBy("__run", *by).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("__upto", upto)
    first = lambda at: F.min(F.when((F.col("__upto") > F.col(at)) & (F.col("__k") > 0), F.col("__v")))
    ends = rows.groupBy(*by).agg(first("__low").alias("__a"), first("__high").alias("__b"), F.first("__part").alias("__part"))
    return ends.select(*by, (F.col("__a") + (F.col("__b") - F.col("__a")) * F.col("__part")).alias(out))


def asof(left: DataFrame, right: DataFrame, by: str, time: str, values: list[str]) -> DataFrame:
    """Each left row with the right row's values last known at its time; no pair is built.

    Both sides are put in order together, right before left at equal times, and right rows of
    equal group and time by their values.  Each run is filled forward on its own; where it begins
    without a right row, the last one of the group's earlier runs is carried over.
    """
    null = [F.lit(None).cast(right.schema[v].dataType).alias(v) for v in values]
    one = left.select(by, time, F.struct(*left.columns).alias("__l"), F.lit(1).alias("__side"), *null)
    two = right.select(by, time, F.lit(None).cast(one.schema["__l"].dataType).alias("__l"), F.lit(0).alias("__side"), *values)
    order = [F.col(c).asc_nulls_first() for c in (time, "__side", *values)]
    runs = sorted_runs(one.unionByName(two), [by], order)
    known = F.when(F.col("__side") == 0, F.struct(*values))
    within = Window.partitionBy("__run", by).orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    ends = runs.where("__side = 0").groupBy("__run", by).agg(F.max_by(F.struct(*values), "__at").alias("__end"))
    # Runs without a right row need the carried one too, so the table has a row for each run and group.
    spans = null_safe_join(runs.select("__run", by).distinct(), ends, ["__run", by], "left")
    carried = spans.withColumn("__carried", F.last("__end", True).over(_before_run([by]))).drop("__end").where(F.col("__carried").isNotNull())
    filled = runs.withColumn("__last", F.last(known, True).over(within)).where("__side = 1").drop(*values)
    filled = null_safe_join(filled, carried, ["__run", by], "left").withColumn("__last", F.coalesce("__last", "__carried"))
    return filled.select("__l.*", *[F.col(f"__last.{v}").alias(v) for v in values])
