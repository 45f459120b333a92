"""Deterministic projections of the driver tables onto the engine's domain, for queries and oracles.

Whole-number arithmetic first and one division last, so that both engines agree bit for bit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


MOL = {
    "id": "o_orderkey",
    "pos": "o_orderkey",
    "cust": "o_custkey",
    "target": "CASE o_orderkey % 3 WHEN 0 THEN 'EGFR' WHEN 1 THEN 'IDH1_IDH2' ELSE 'VEGF_VEGFR' END",
    "mw": "150 + ((o_orderkey * 7919 + o_custkey * 31) % 60000) / 100",
    "logp": "((o_orderkey * 37 + o_custkey * 11) % 900) / 100 - 1.5e0",
    "tpsa": "((o_orderkey * 53 + o_custkey * 13) % 18000) / 100",
    "hbd": "(o_orderkey + o_custkey) % 7",
    "hba": "(o_orderkey * 3 + o_custkey) % 13",
    "vina": "-3 - ((o_orderkey * 101 + o_custkey * 17) % 1000) / 100",
    "dili": "((o_orderkey * 29) % 100) / 100",
    "herg": "((o_custkey * 43 + o_orderkey) % 100) / 100",
    "alerts": "(o_orderkey * 7 + o_custkey) % 5",
    "pains": "(o_orderkey * 11) % 4",
    "rings": "(o_custkey * 3 + o_orderkey) % 7",
    "heavy": "6 + (o_orderkey * 13 + o_custkey) % 60",
    "chiral": "(o_orderkey * 5) % 4",
    "qed": "((o_orderkey * 17 + o_custkey) % 100) / 100",
    "flag": "o_orderkey % 2 = 0",
}


def mol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(*[F.expr(e).alias(n) for n, e in MOL.items()])


MOL_SQL = "mol AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in MOL.items()) + " FROM orders)"
