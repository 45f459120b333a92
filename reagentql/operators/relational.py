"""Relational operators: ranking, novelty, first-seen, streaks, sampling, splits, summaries."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reagentql.operators.intervals import within_intervals  # noqa: F401
from reagentql.operators.ordered import asof, exact_quantile, null_safe_join, numbered  # noqa: F401


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group with their rank; the order should end in a unique column."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def first_seen(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of rows with equal keys the first in order."""
    return top_per_group(df, keys, order, 1, "__first").drop("__first")


def keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of rows with equal keys the last in order."""
    return first_seen(df, keys, [c.desc() for c in order])


def novel(df: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not known."""
    return df.join(known.select(*keys).distinct(), keys, "left_anti")


def already_known(df: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are known."""
    return df.join(known.select(*keys).distinct(), keys, "left_semi")


def sequence_ids(df: DataFrame, group: str, position: str, ties: list[Column] = (), out: str = "seq_id", width: int = 5) -> DataFrame:
    """group_00000, group_00001, ... by position within each group; ids of a null group begin with the underscore."""
    rows = numbered(df, [group], position, list(ties), "__i")
    return rows.withColumn(out, F.concat(F.coalesce(F.col(group).cast("string"), F.lit("")), F.lit("_"), F.lpad(F.col("__i").cast("string"), width, "0"))).drop("__i")


def rebuilt_ids(df: DataFrame, group: str, key: str, position: str, out: str = "seq_id", width: int = 5) -> DataFrame:
    """The first row of each key over all groups, with new sequence ids in each group."""
    return sequence_ids(first_seen(df, [key], [F.col(position)]), group, position, [], out, width)


def attempt_streaks(attempts: DataFrame, group: str, attempt: str, key: str, position: str, stop_after: int = 3, enough: int | None = None) -> DataFrame:
    """Per group and attempt: new keys, running total of distinct keys, length of the dry streak, and whether to stop.

    A key is new in the attempt of its first position.  The loop stops once ``stop_after``
    attempts in a row found nothing new, or ``enough`` keys are known.
    """
    w = Window.partitionBy(group, key).orderBy(attempt, position)
    marked = attempts.withColumn("__new", (F.row_number().over(w) == 1).cast("long"))
    per = marked.groupBy(group, attempt).agg(F.sum("__new").alias("new"))
    order = Window.partitionBy(group).orderBy(attempt)
    per = per.withColumn("total", F.sum("new").over(order)).withColumn("__island", F.sum((F.col("new") > 0).cast("long")).over(order))
    dry = F.when(F.col("new") > 0, 0).otherwise(F.count("*").over(Window.partitionBy(group, "__island").orderBy(attempt)) - (F.col("__island") > 0).cast("long"))
    per = per.withColumn("dry", dry.cast("long")).drop("__island")
    stop = F.col("dry") >= stop_after
    if enough is not None:
        stop = stop | (F.col("total") >= enough)
    return per.withColumn("stop", stop)


def hash_order(*columns: Column | str, seed: int = 42) -> Column:
    """A reproducible shuffle key that other engines can compute: md5 of seed and key."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *[F.col(c).cast("string") if isinstance(c, str) else c for c in columns]))


def stratified_sample(df: DataFrame, stratum: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows of each stratum (all of smaller ones), without replacement."""
    return top_per_group(df, [stratum], [hash_order(key, seed=seed), F.col(key)], n, "__n").drop("__n")


def split_rows(df: DataFrame, stratum: str, key: str, shares: tuple[tuple[str, float], ...] = (("train", 0.8), ("valid", 0.1), ("test", 0.1)), seed: int = 42) -> DataFrame:
    """Exact shares of every stratum in hash order, the last share taking the rest; rows of a null stratum are one."""
    rows = numbered(df.withColumn("__h", hash_order(key, seed=seed)), [stratum], "__h", [F.col(key)], "__i", "__n").drop("__h")
    out, until = F.lit(shares[-1][0]), F.lit(0)
    bounds = []
    for name, share in shares[:-1]:
        until = until + F.floor(F.col("__n") * F.lit(share))
        bounds.append((name, until))
    for name, until in reversed(bounds):
        out = F.when(F.col("__i") < until, name).otherwise(out)
    return rows.withColumn("split", out).drop("__i", "__n")


def pad_rows(df: DataFrame, group: str, order: list[Column], n: int, filler: dict[str, Column], groups: DataFrame | None = None) -> DataFrame:
    """Exactly ``n`` rows per group (of ``groups``, if given), numbered from 1; missing ones carry the filler values, a null group is one."""
    ranked = top_per_group(df, [group], order, n, "slot")
    slots = (df if groups is None else groups).select(group).distinct().withColumn("slot", F.explode(F.sequence(F.lit(1), F.lit(n))))
    out = null_safe_join(slots, ranked, [group, "slot"], "left")
    return out.withColumns({c: F.coalesce(F.col(c), v) for c, v in filler.items()})


def summary(df: DataFrame, value: str, by: list[str] = (), high: float = 0.7) -> DataFrame:
    """Count, mean, extremes, median and both deviations of a value, and how many exceed ``high``; null groups are one.

    The median leaves NaN out, as it does null; the other figures follow Spark's rules for NaN.
    """
    v = F.col(value)
    out = df.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count(v).alias("n_valid"),
        F.round(F.avg(v), 6).alias("mean"),
        F.round(F.min(v), 6).alias("low"),
        F.round(F.max(v), 6).alias("high"),
        F.round(F.stddev_pop(v), 6).alias("std_pop"),
        F.round(F.stddev_samp(v), 6).alias("std_samp"),
        F.count_if(v > high).alias("n_high"),
    )
    middle = exact_quantile(df, list(by), value, 0.5, "median").withColumn("median", F.round("median", 6))
    return null_safe_join(out, middle, list(by), "left")


def correlations(df: DataFrame, columns: list[str], pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """a, b, r for every pair of columns (or the pairs given) in one aggregate; null where a column is constant."""
    pairs = list(combinations_with_replacement(columns, 2)) if pairs is None else pairs
    r = lambda a, b: F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))
    one = df.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(r(a, b), 6).alias("r")) for a, b in pairs]).alias("p"))
    return one.select(F.inline("p"))


def histogram(df: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """bin (0-based), n over equal bins between minimum and maximum, the last one closed."""
    ends = df.agg(F.min(value).alias("low"), F.max(value).alias("high"))
    width = (F.col("high") - F.col("low")) / bins
    at = F.when(width == 0, 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("low")) / width)))
    return df.where(F.col(value).isNotNull()).join(F.broadcast(ends)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def min_max(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns scaled to [0, 1] over the table; 0 where a column is constant."""
    ends = df.agg(*[f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("low", F.min), ("high", F.max))])
    scaled = {c: F.coalesce(F.try_divide(F.col(c) - F.col(f"__low_{c}"), F.col(f"__high_{c}") - F.col(f"__low_{c}")), F.lit(0.0)) for c in columns}
    return df.join(F.broadcast(ends)).select(*[scaled[c].alias(c) if c in scaled else F.col(c) for c in df.columns])


def unpivot_above(wide: DataFrame, ids: list[str], columns: list[str], name: str, value: str, least: float, strict: bool = False) -> DataFrame:
    """Long rows of a wide matrix with values at or above (strictly: above) a threshold."""
    long = wide.unpivot(ids, columns, name, value)
    return long.where(F.col(value) > least if strict else F.col(value) >= least)


def weighted_pick(df: DataFrame, key: str, weights: dict[str, float], out: str, seed: int = 42) -> DataFrame:
    """A weighted pick per row by a hashed uniform number: the first name whose cumulative weight exceeds it."""
    total = sum(weights.values())
    u = F.conv(F.substring(hash_order(key, seed=seed), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    pick, reached = F.lit(list(weights)[-1]), total
    for name, weight in reversed(list(weights.items())[:-1]):
        reached -= weights[list(weights)[list(weights).index(name) + 1]]
        pick = F.when(u < round(reached / total, 9), name).otherwise(pick)
    return df.withColumn(out, pick)


def beam(level_tables: list[DataFrame], parent: str, node: str, order: list[Column], width: int) -> DataFrame:
    """Level-wise beam: each level keeps the best ``width`` children of the nodes kept above, with their paths.

    Each table has ``parent``, ``node`` and the columns of ``order``; the first one's parent is null.
    """
    kept = None
    for table in level_tables:
        if kept is None:
            rows = table.withColumn("path", F.array(F.col(node).cast("string")))
        else:
            above = kept.select(F.col(node).alias(parent), F.col("path").alias("__path"))
            rows = table.join(above, parent).withColumn("path", F.concat("__path", F.array(F.col(node).cast("string")))).drop("__path")
        kept = top_per_group(rows, [parent], order, width, "__beam").drop("__beam")
    return kept


def z_scores(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as distances from the table's mean in sample deviations; 0 where a column is constant, null stays null."""
    ends = df.agg(*[f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_samp))])
    off = {c: F.col(c) - F.col(f"__mean_{c}") for c in columns}
    scaled = {c: F.when(off[c].isNotNull(), F.coalesce(F.try_divide(off[c], F.col(f"__std_{c}")), F.lit(0.0))) for c in columns}
    return df.join(F.broadcast(ends)).select(*[scaled[c].alias(c) if c in scaled else F.col(c) for c in df.columns])


def cross_correlations(df: DataFrame, left: list[str], right: list[str]) -> DataFrame:
    """a, b, r of every column of ``left`` with every column of ``right``; pairs without a correlation are left out."""
    return correlations(df, [], [(a, b) for a in left for b in right]).where("r IS NOT NULL")


def run_summary(df: DataFrame, group: str, key: str, length: Column) -> DataFrame:
    """Per group: rows, distinct keys, mean length, and the share of distinct keys as a number and as text."""
    n, new = F.count("*"), F.count_distinct(key)
    return df.groupBy(group).agg(
        n.alias("n"),
        new.alias("n_distinct"),
        F.round(F.avg(length), 6).alias("mean_length"),
        F.round(F.try_divide(new, n), 6).alias("rate"),
        F.coalesce(F.format_string("%.1f%%", F.round(F.try_divide(100.0 * new, n), 1)), F.lit("N/A")).alias("shown"),
    )


def parent_delta(df: DataFrame, group: str, order: list[Column], value: str, out: str = "delta") -> DataFrame:
    """How far a value rose against the row before it in its group; null for the first."""
    return df.withColumn(out, F.round(F.col(value) - F.lag(value).over(Window.partitionBy(group).orderBy(*order)), 6))


def balanced(first: DataFrame, second: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of one table and the first half as many of another."""
    return first.orderBy(*order).limit(n).unionByName(second.orderBy(*order).limit(n // 2))


def renumber(df: DataFrame, column: str, mapping: DataFrame, old: str, new: str, order: list[str]) -> DataFrame:
    """``column`` renamed by a mapping whose last row per old number wins; numbers it lacks stay."""
    last = mapping.groupBy(F.col(old).alias(column)).agg(F.max_by(new, F.struct(*order)).alias("__new"))
    return df.join(last, column, "left").withColumn(column, F.coalesce("__new", column)).drop("__new")


def mean_of_selected(df: DataFrame, group: str, value: str, selected: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of a value per group over the rows whose keys are selected; NaN for a group without such rows."""
    marks = selected.select(*keys).distinct().withColumn("__in", F.lit(True))
    mean = F.avg(F.when(F.col("__in"), F.col(value)))
    return df.join(marks, keys, "left").groupBy(group).agg(F.round(F.coalesce(mean, F.lit(float("nan"))), 6).alias("mean"))


def above(df: DataFrame, value: str, least: float, n: int, ties: list[Column]) -> DataFrame:
    """The ``n`` rows with the highest values at or above a threshold."""
    return df.where(F.col(value) >= least).orderBy(F.desc(value), *ties).limit(n)


def with_status(df: DataFrame, column: str, wanted: tuple[str, ...] = ("Approved", "Phase 3", "Phase 2"), order: list[Column] = (), n: int = 10) -> DataFrame:
    """The first ``n`` rows in order whose status is wanted."""
    return df.where(F.col(column).isin(*wanted)).orderBy(*order).limit(n)


def best_first(df: DataFrame, value: str, position: str) -> DataFrame:
    """All rows with their place from 1 by descending value, equal ones by position, null values last.

    Places are found run by run, so no task sorts the table, and it is sorted once; order by
    ``place`` where rows are to be shown in order.
    """
    rows = df.withColumn("__v", -F.coalesce(F.nullif(F.col(value).cast("double"), F.lit(float("nan"))), F.lit(float("-inf"))))
    return numbered(rows, [], "__v", [F.col(position)], "place").withColumn("place", F.col("place") + 1).drop("__v")


def best_of(df: DataFrame, group: str, value: str, order: list[str]) -> DataFrame:
    """Of each group the row with the highest value, a null value counting as 0, the first of equals."""
    return first_seen(df.withColumn("__v", F.coalesce(F.col(value), F.lit(0.0))), [group], [F.desc("__v"), *map(F.col, order)]).drop("__v")


def matched(proposals: DataFrame, evaluations: DataFrame, keys: list[str]) -> DataFrame:
    """Proposals with their evaluations by key; proposals without one stay."""
    return proposals.join(evaluations.dropDuplicates(keys), keys, "left")


def per_state(df: DataFrame, state: str, value: str, least: float = 0.8, n: int = 500, order: list[Column] = ()) -> DataFrame:
    """The first ``n`` rows of each state with a value at or above the threshold."""
    return top_per_group(df.where(F.col(value) >= least), [state], list(order), n, "__n").drop("__n")


def outcome_counts(df: DataFrame, error: str) -> DataFrame:
    """total, success and failed rows; a row fails if it has an error."""
    return df.agg(F.count("*").alias("total"), F.count_if(F.col(error).isNull()).alias("success"), F.count_if(F.col(error).isNotNull()).alias("failed"))


def template_pick(df: DataFrame, key: str, templates: tuple[str, ...], out: str, seed: int = 42) -> DataFrame:
    """One of some texts per row, by hash of its key."""
    n = F.conv(F.substring(hash_order(key, seed=seed), 1, 8), 16, 10).cast("long") % len(templates)
    return df.withColumn(out, F.element_at(F.array(*[F.lit(t) for t in templates]), (n + 1).cast("int")))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """value, n of every value; null is one."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def grouped_reports(df: DataFrame, sets: list[list[str]], aggregates: list[Column]) -> DataFrame:
    """Aggregates over several sets of columns at once (grouping sets), each row with its ``level``."""
    every = list(dict.fromkeys(x for s in sets for x in s))
    return df.groupingSets([[F.col(x) for x in s] for s in sets], *every).agg(F.grouping_id().alias("level"), *aggregates)


def canonical_names(names: Column) -> Column:
    """Slashes and blanks as underscores."""
    return F.translate(names, "/ ", "__")


def looked_up(rows: DataFrame, key: str, wanted: list, columns: dict[str, Column]) -> DataFrame:
    """The key and some columns of each row that is wanted, in the order asked; a key that is missing has nulls, and empty lists and maps."""
    asked = rows.sparkSession.createDataFrame([(k, i) for i, k in enumerate(wanted)], f"__key {rows.schema[key].dataType.simpleString()}, place int")
    found = rows.join(F.broadcast(asked.select(F.col("__key").alias(key))), key, "left_semi").select(F.col(key).alias("__key"), *[v.alias(n) for n, v in columns.items()])
    out = F.broadcast(asked).join(found, "__key", "left")
    empty = {"array": F.array, "map": F.create_map}
    kinds = {f.name: f.dataType for f in out.schema.fields}
    filled = {n: F.coalesce(F.col(n), empty[kinds[n].typeName()]().cast(kinds[n])) for n in columns if kinds[n].typeName() in empty}
    return out.withColumns(filled).withColumnRenamed("__key", key)


def synergies(combinations: DataFrame, index: str = "Combination_Index", least: float = 1.0) -> DataFrame:
    """The rows of a combination table whose index is above ``least``; indices that are missing or no numbers are not."""
    return combinations.where(F.col(index).isNotNull() & ~F.isnan(F.col(index).cast("double")) & (F.col(index) > least))
