"""Versions of a table by compare and swap, and a sink that takes each batch of a stream once.

A table is a folder with ``data`` (Parquet folders that are never changed) and ``log`` (one small
file a version, named by its number, which says what the version adds and whether it replaces all
before it).  A version counts from the moment its log file stands, and a log file is put in place
by one step that fails where the file is already there.  Data that no log file names is not read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.window import Window

from reagentql.storage import delete, hadoop_path


class Conflict(Exception):
    """Another writer has put the version in place."""


class Ledger:
    """The versions of the table in a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def versions(self) -> list[dict]:
        """What each version says, in order."""
        where, files = hadoop_path(self.spark, f"{self.folder}/log")
        if not files.exists(where):
            return []
        names = sorted(s.getPath().getName() for s in files.listStatus(where))
        return [self._read(n) for n in names if n.endswith(".json") and not n.startswith((".", "_"))]

    def _read(self, name: str) -> dict:
        where, files = hadoop_path(self.spark, f"{self.folder}/log/{name}")
        stream = files.open(where)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def stage(self, df: DataFrame) -> str:
        """Write rows that do not count yet; the name of their folder."""
        name = uuid.uuid4().hex
        df.write.parquet(f"{self.folder}/data/{name}")
        return name

    def commit(self, version: int, entry: dict) -> None:
        """Put a version in place, or raise Conflict if it is there."""
        jvm = self.spark._jvm
        target, files = hadoop_path(self.spark, f"{self.folder}/log/{version:012d}.json")
        part, _ = hadoop_path(self.spark, f"{self.folder}/log/.{uuid.uuid4().hex}")
        stream = files.create(part, False)
        stream.write(bytearray(json.dumps(entry | {"version": version}).encode()))
        stream.close()
        try:
            if target.toUri().getScheme() in (None, "file") and files.getUri().getScheme() == "file":
                paths = jvm.java.nio.file.Paths
                none = self.spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0)
                jvm.java.nio.file.Files.createLink(paths.get(target.toUri().getPath(), none), paths.get(part.toUri().getPath(), none))
            else:
                rename = jvm.org.apache.hadoop.fs.Options.Rename
                options = self.spark.sparkContext._gateway.new_array(rename, 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration()).rename(part, target, options)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                raise Conflict(version) from None
            raise
        finally:
            files.delete(part, False)

    def read(self, schema: str | None = None) -> DataFrame | None:
        """The rows that count, with _version; None where nothing has been written and no schema is given."""
        entries = self.versions()
        last = max([i for i, e in enumerate(entries) if e.get("replaces")], default=0)
        entries = [e for e in entries[last:] if e.get("data")]
        out = None
        for e in entries:
            rows = self.spark.read.parquet(f"{self.folder}/data/{e['data']}").withColumn("_version", F.lit(e["version"]).cast("long"))
            out = rows if out is None else out.unionByName(rows, True)
        if out is None and schema is not None:
            out = self.spark.createDataFrame([], schema).withColumn("_version", F.lit(None).cast("long"))
        return out

    def newest(self, keys: list[str]) -> DataFrame | None:
        """Of rows with equal keys those of the last version that has them (update mode)."""
        rows = self.read()
        if rows is None:
            return None
        w = Window.partitionBy(*keys).orderBy(F.desc("_version"))
        return rows.withColumn("__n", F.rank().over(w)).where("__n = 1").drop("__n")

    def append_new(self, df: DataFrame, keys: list[str], tries: int = 20, before_commit: Callable[[], None] | None = None) -> int:
        """Append the rows whose keys the table lacks, once each; how many.

        Rows are staged against the versions read and committed as the next one.  If another
        writer has got there first, only its rows are compared again with what was staged.
        """
        fresh = df.dropDuplicates(keys)
        for _ in range(tries):
            known = self.versions()
            table = self.read()
            rows = fresh if table is None else fresh.join(table.select(*keys), keys, "left_anti")
            name = self.stage(rows)
            added = self.spark.read.schema(df.schema).parquet(f"{self.folder}/data/{name}").count()
            if before_commit:
                before_commit()
            try:
                if added:
                    self.commit(len(known), {"data": name, "rows": added})
                else:
                    delete(self.spark, f"{self.folder}/data/{name}")
                return added
            except Conflict:
                delete(self.spark, f"{self.folder}/data/{name}")
        raise Conflict("too many writers at once")

    def sweep(self) -> int:
        """Delete data that no version names, which crashed writers have left; how many folders.  Not to be run beside writers."""
        where, files = hadoop_path(self.spark, f"{self.folder}/data")
        if not files.exists(where):
            return 0
        named = {e.get("data") for e in self.versions()}
        loose = [s.getPath() for s in files.listStatus(where) if s.getPath().getName() not in named]
        for path in loose:
            files.delete(path, True)
        return len(loose)


def publish_batch(ledger: Ledger, stream: str, mode: str = "append", after_stage: Callable[[int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that publishes each batch of a stream exactly once.

    A batch that is in the log is passed over.  Otherwise its rows are staged and then committed
    with the stream's name and the batch's id; if the run ends between the two, the staged rows do
    not count, and the replayed batch is staged anew.  In mode ``complete`` a batch replaces what
    came before it; in mode ``update`` read the table by ``newest``.
    """

    def write(rows: DataFrame, batch: int) -> None:
        while True:
            entries = ledger.versions()
            if any(e.get("stream") == stream and e.get("batch") == batch for e in entries):
                return
            name = ledger.stage(rows)
            if after_stage:
                after_stage(batch)
            try:
                ledger.commit(len(entries), {"data": name, "stream": stream, "batch": batch, "replaces": mode == "complete"})
                return
            except Conflict:
                delete(ledger.spark, f"{ledger.folder}/data/{name}")

    return write


def to_ledger(rows: DataFrame, ledger: Ledger, checkpoint: str, stream: str, mode: str = "append", after_stage: Callable[[int], None] | None = None) -> DataStreamWriter:
    """A writer of a stream into a ledger, exactly once, in output mode append, update or complete."""
    return rows.writeStream.outputMode(mode).foreachBatch(publish_batch(ledger, stream, mode, after_stage)).option("checkpointLocation", checkpoint)


def changed_since(ledger: Ledger, version: int, condition: Column | None = None) -> DataFrame | None:
    """The rows of versions after one that was read, for readers that follow a table."""
    rows = ledger.read()
    if rows is None:
        return None
    rows = rows.where(F.col("_version") > version)
    return rows if condition is None else rows.where(condition)
