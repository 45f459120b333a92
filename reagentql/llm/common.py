"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints.

    The session's own setting wins; only where it is unset in a local session (tests) is a
    folder next to the warehouse used.  On a cluster it must be set.  Spark gives each
    application a folder of its own there, which goes when the driver ends.
    """
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
            folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-checkpoints"
        context.setCheckpointDir(folder)
    own = context._jsc.sc().getCheckpointDir().get()
    where = spark._jvm.org.apache.hadoop.fs.Path(own)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return own


#: Bytes of the batches in which rows go to Python, unless the session says otherwise.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on rows go to Python in batches of about BATCH_BYTES; the session's own setting wins.

    Spark's default is 10,000 rows or 64 MB, and of a batch of whole texts or shingle sets both the
    executor and its Python worker hold several copies.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint that outlives executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Tables in a folder of their own within the shared checkpoint folder."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{checkpoint_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"
        self.paths: list[str] = []

    def spill(self, df: DataFrame) -> DataFrame:
        """Write a table and read it back."""
        self.paths.append(f"{self.folder}/{len(self.paths)}")
        df.write.parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def last(self, df: DataFrame) -> DataFrame:
        """Write the result, and delete the tables that led to it; the result's own stays for its reader."""
        used = list(self.paths)
        out = self.spill(df)
        for path in used:
            delete(self.spark, path)
        return out


#: A key is hot if it holds over this part of all rows: fewer keys than that can be. Hot keys are dealt over SALTS tasks.
HOT_PART, SALTS = 1000, 64


def join_on_hot(rows: DataFrame, info: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` (``total`` of them) with the columns of ``info`` for their key; rows of other keys drop out.

    ``info`` has each key once, and as n its number of rows.  The fewer than HOT_PART keys that
    hold over one HOT_PART-th of the rows are broadcast to salt their rows, so that no task gets
    all rows of a hot key.
    """
    hot = F.col("n") * HOT_PART > F.lit(total)
    few = F.broadcast(info.where(hot).select(key, F.lit(True).alias("__hot")))
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).otherwise(0)
    dealt = rows.join(few, key, "left").withColumn("__salt", salt).drop("__hot")
    salts = F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(info.withColumn("__salt", F.explode(salts)), [key, "__salt"]).drop("__salt", "n")


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator reads, under fixed names; null text becomes empty."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def map_texts(
    df: DataFrame,
    make: Callable[[], Callable[[list, list[str]], Iterable[pa.RecordBatch]]],
    schema: str,
) -> DataFrame:
    """Run a text function over whole Arrow batches.

    ``df`` has the columns doc_id and text.  ``make`` is called once per task and returns
    the function from (ids, texts) to result batches, so its caches live as long as a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            if batch.num_rows:
                yield from f(batch.column(0), batch.column(1).to_pylist())

    return df.mapInArrow(run, schema)


class BoundedCache(dict):
    """A dict that computes missing values and is emptied when it reaches its bound."""

    def __init__(self, compute: Callable, bound: int):
        super().__init__()
        self.compute, self.bound = compute, bound

    def __missing__(self, key):
        if len(self) >= self.bound:
            self.clear()
        value = self.compute(key)
        if len(key) <= 64:
            self[key] = value
        return value


def span_arrays(rows: list[list[tuple]], kinds: bool = True) -> pa.ListArray:
    """Lists of (kind, start, end, score) as an Arrow list of structs."""
    offsets, kind, start, end, score = [0], [], [], [], []
    for spans in rows:
        for s in spans:
            kind.append(s[0])
            start.append(s[1])
            end.append(s[2])
            score.append(s[3])
        offsets.append(len(kind))
    struct = pa.StructArray.from_arrays(
        [pa.array(kind, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(score, pa.float64())],
        ["kind", "start", "end", "score"],
    )
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct)


SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"
