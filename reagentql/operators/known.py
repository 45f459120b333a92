"""Known keys of earlier runs under a Bloom index, so that novelty is settled without shuffling history.

A store is a folder with ``keys`` (the known keys, by run and part) and ``blocks`` (the index).
A key sets four bits in one block of 64, chosen by its hash among the blocks of its run, so a
block is one whole number, testing a key is one row of a join, and a run's index is about a
byte a key.  Blocks are never rewritten: a run adds its own.

Rows whose blocks have all their bits are looked up in the keys, and only in the parts they can
be in; all other rows are new without a look at history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reagentql.storage import hadoop_path

#: Keys that a block of 64 bits stands for, on average, and parts of a run's keys.
KEYS_A_BLOCK, PARTS = 8, 64


def _key(keys: list[str]) -> Column:
    """Keys as one text in which null differs from every value."""
    return F.to_json(F.struct(*[F.col(k).cast("string").alias(f"k{i}") for i, k in enumerate(keys)]))


def _hash(key: Column, salt: int) -> Column:
    return F.xxhash64(key, F.lit(salt))


def _mask(key: Column) -> Column:
    """Four bits of 64 by hash."""
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), F.call_function("shiftrightunsigned", _hash(key, 1), F.lit(6 * i)).bitwiseAND(F.lit(63)).cast("int"))
    return bit(0).bitwiseOR(bit(1)).bitwiseOR(bit(2)).bitwiseOR(bit(3))


def _part(key: Column) -> Column:
    return F.pmod(_hash(key, 2), F.lit(PARTS)).cast("int")


class KnownKeys:
    """The known keys of a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _table(self, name: str) -> DataFrame | None:
        where, files = hadoop_path(self.spark, f"{self.folder}/{name}")
        return self.spark.read.parquet(f"{self.folder}/{name}") if files.exists(where) else None

    def add(self, run: int, rows: DataFrame, keys: list[str]) -> None:
        """Add a run's keys and its blocks; a repeated run replaces what it wrote before."""
        known = rows.select(_key(keys).alias("key")).distinct().withColumn("part", _part(F.col("key")))
        known.repartition(F.col("part")).write.mode("overwrite").partitionBy("part").parquet(f"{self.folder}/keys/run={run}")
        written = self.spark.read.schema("key string, part int").parquet(f"{self.folder}/keys/run={run}")
        n = max(1, written.count() // KEYS_A_BLOCK)
        block = F.pmod(_hash(F.col("key"), 3), F.lit(n)).alias("block")
        blocks = written.groupBy(block).agg(F.bit_or(_mask(F.col("key"))).alias("bits")).withColumn("of", F.lit(n).cast("long"))
        blocks.write.mode("overwrite").parquet(f"{self.folder}/blocks/run={run}")

    def possible(self, rows: DataFrame) -> DataFrame:
        """run, key, part of the rows (key, once each) whose blocks of a run have all their bits; about one new key in fourteen a run is among them."""
        blocks = self._table("blocks")
        sizes = blocks.groupBy("run").agg(F.first("of").alias("of"))  # a row a run
        asked = rows.join(F.broadcast(sizes)).withColumn("block", F.pmod(_hash(F.col("key"), 3), F.col("of")))
        found = asked.join(blocks.select("run", "block", "bits"), ["run", "block"])
        return found.where(F.col("bits").bitwiseAND(_mask(F.col("key"))) == _mask(F.col("key"))).select("run", "key", _part(F.col("key")).alias("part"))

    def novel(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        """The rows whose keys no run has; null keys are keys like any other."""
        named = rows.withColumn("__key", _key(keys))
        if self._table("blocks") is None:
            return named.drop("__key")
        hits = self.possible(named.select(F.col("__key").alias("key")).distinct())
        known = self._table("keys")
        seen = hits.join(known, ["run", "part", "key"], "left_semi").select(F.col("key").alias("__key")).distinct()
        return named.join(seen, "__key", "left_anti").drop("__key")

    def share_looked_up(self, rows: DataFrame, keys: list[str]) -> float:
        """Of the rows' keys, the share that the index could not settle."""
        asked = rows.select(_key(keys).alias("key")).distinct()
        return self.possible(asked).select("key").distinct().count() / max(1, asked.count())
