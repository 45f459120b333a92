"""Tables that operators write for themselves, in the folder all machines share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.

    Only where it is unset in a local session (tests) is a folder next to the warehouse used.
    """
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-checkpoints"
    return folder.rstrip("/")


def hadoop_path(spark: SparkSession, path: str):
    """A Hadoop path and its file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system."""
    where, files = hadoop_path(spark, path)
    files.delete(where, True)


def own_folder(spark: SparkSession) -> str:
    """A new folder in the shared one, which goes when the driver ends."""
    folder = f"{shared_folder(spark)}/own-{uuid.uuid4().hex}"
    where, files = hadoop_path(spark, folder)
    files.mkdirs(where)
    files.deleteOnExit(where)  # only a folder that is there can be marked
    return folder


def spilled(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` written as Parquet and read back, so that its rows and their partitions are settled and outlive executors.

    Without a path the table lies in the shared folder until the driver ends or someone deletes it.
    """
    spark = df.sparkSession
    if path is None:
        path = f"{own_folder(spark)}/rows"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
