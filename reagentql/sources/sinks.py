"""Sinks: JSON, fixed-format CSV, idempotent appends, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reagentql.operators.relational import novel, sequence_ids


def two_decimals(x: Column) -> Column:
    return F.format_string("%.2f", x)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_candidates_csv(df: DataFrame, path: str, target: str = "target", order: str = "smiles") -> None:
    """Sequence id, target, smiles and properties with two decimals, under a header."""
    numbered = sequence_ids(df, target, order)
    shown = [two_decimals(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in numbered.dtypes]
    numbered.select(*shown).write.mode("overwrite").option("header", True).csv(path)


def append_new(df: DataFrame, path: str, keys: list[str]) -> int:
    """Append the rows whose keys the Parquet table at ``path`` does not hold yet; the number of rows added.

    Repeating the call adds nothing.
    """
    spark = df.sparkSession
    fresh = df.dropDuplicates(keys)
    try:
        fresh = novel(fresh, spark.read.parquet(path), keys)
    except Exception as e:  # no table yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
            raise
    fresh = fresh.cache()
    try:
        added = fresh.count()
        if added:
            fresh.write.mode("append").parquet(path)
        return added
    finally:
        fresh.unpersist()


def write_state(results: DataFrame, path: str, attempt: int) -> None:
    """The whole result table after an attempt, in a folder of its own; a repeated attempt replaces its folder."""
    results.write.mode("overwrite").parquet(f"{path}/attempt={attempt}")


def last_state(spark: SparkSession, path: str) -> DataFrame:
    """The result table of the last attempt that was written."""
    rows = spark.read.parquet(path)
    return rows.where(F.col("attempt") == rows.agg(F.max("attempt")).first()[0]).drop("attempt")


def summary_report(rows: DataFrame, name: str = "target_name", error: str = "error") -> DataFrame:
    """One JSON document: totals, how many succeeded and failed, and each target's status by name."""
    status = F.when(F.col(error).isNull(), "success").otherwise("failed")
    one = rows.agg(
        F.count("*").alias("total"),
        F.count_if(F.col(error).isNull()).alias("success"),
        F.count_if(F.col(error).isNotNull()).alias("failed"),
        F.array_sort(F.collect_list(F.struct(F.col(name).alias("target"), status.alias("status"), F.col(error).alias("error")))).alias("targets"),
    )
    return one.select(F.to_json(F.struct("total", "success", "failed", "targets")).alias("report"))


def write_structures(structures: DataFrame, folder: str, name: str = "file") -> None:
    """Whole structures (``operators.structure.whole_structure``) as JSON, in three tables of a folder.

    ``structures`` has a folder for each structure, ``summaries`` a line each with counts instead of
    lists and the error if there is one, ``totals`` one line of how many succeeded and failed.  No
    task holds more than a row at a time.
    """
    lists = [f.name for f in structures.schema.fields if f.dataType.typeName() == "array" and f.name != "chains"]
    counts = [F.size(F.coalesce(n, F.array().cast(structures.schema[n].dataType))).alias(f"n_{n}") for n in lists]
    status = F.when(F.col("error").isNull(), "success").otherwise("failed").alias("status")
    kept = [c for c in structures.columns if c not in (*lists, "pharmacophore")]
    structures.write.mode("overwrite").partitionBy(name).json(f"{folder}/structures")
    structures.select(*kept, *counts, status).write.mode("overwrite").json(f"{folder}/summaries")
    totals = structures.agg(F.count("*").alias("total"), F.count_if(F.col("error").isNull()).alias("success"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    totals.write.mode("overwrite").json(f"{folder}/totals")


def console_lines(rows: DataFrame, title: str, columns: dict[str, str]) -> DataFrame:
    """A readable line per row: the title column, then ``label: value`` parts by their formats."""
    parts = [F.when(F.col(n).isNotNull(), F.concat(F.lit(f"{n}: "), F.format_string(form, F.col(n)))) for n, form in columns.items()]
    return rows.select(F.col(title), F.concat_ws(" | ", F.col(title), *parts).alias("line"))


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    df.write.mode("overwrite").partitionBy(split).json(path)


def report(rows: DataFrame, value: str) -> DataFrame:
    """One JSON document with the totals of a value."""
    one = rows.agg(F.count("*").alias("total"), F.round(F.avg(value), 6).alias("mean"), F.max(value).alias("best"))
    return one.select(F.to_json(F.struct("total", "mean", "best")).alias("report"))
