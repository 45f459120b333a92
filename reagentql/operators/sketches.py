"""Mergeable sketches of runs: distinct counts and quantiles without the runs' rows.

Each run leaves one row a group with its count, a sketch of its distinct keys and one of its
values.  Rows of any runs merge into the sketch of their union, so a report over a year of runs
reads sketches, not data.  ``exact_report`` is the exact form beside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reagentql.operators.ordered import exact_quantile, null_safe_join

#: log2 of the registers of distinct counts (standard error about 1.04 / 2^(bits / 2)), and size of quantile sketches (rank error about 1.3 % at 200).
DISTINCT_BITS, QUANTILE_SIZE = 12, 200


def run_sketches(df: DataFrame, by: list[str], key: str, value: str) -> DataFrame:
    """by, n, keys, numbers: one row a group with its sketches; null keys and null or NaN values are left out of them."""
    x = F.col(value).cast("double")
    return df.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.hll_sketch_agg(F.col(key).cast("string"), F.lit(DISTINCT_BITS)).alias("keys"),
        F.kll_sketch_agg_double(F.nullif(x, F.lit(float("nan"))), F.lit(QUANTILE_SIZE)).alias("numbers"),
    )


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """The sketches of the union of runs, in the form of ``run_sketches``, so that they merge again."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("keys").alias("keys"), F.kll_merge_agg_double("numbers").alias("numbers"))


def distinct_keys() -> Column:
    return F.hll_sketch_estimate("keys")


def quantile(share: float) -> Column:
    return F.when(F.kll_sketch_get_n_double("numbers") > 0, F.kll_sketch_get_quantile_double("numbers", F.lit(share)))


def report(sketches: DataFrame, by: list[str], share: float = 0.5) -> DataFrame:
    """by, n, n_distinct, quantile, estimated from sketches."""
    return sketches.select(*by, "n", distinct_keys().alias("n_distinct"), quantile(share).alias("quantile"))


def exact_report(df: DataFrame, by: list[str], key: str, value: str, share: float = 0.5) -> DataFrame:
    """The same columns computed from the rows."""
    counts = df.groupBy(*by).agg(F.count("*").alias("n"), F.count_distinct(F.col(key)).alias("n_distinct"))
    return null_safe_join(counts, exact_quantile(df, by, value, share, "quantile"), by)
