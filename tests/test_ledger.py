"""Versions, exactly-once batches and clocks of streams."""

from __future__ import annotations

import threading
import time

import pytest
from pyspark.sql import functions as F

from reagentql.sources.ledger import Conflict, Ledger, publish_batch, to_ledger
from reagentql.streaming import collect


class Killed(Exception):
    pass


def batches(spark, folder, parts, schema):
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def run(writer):
    q = writer.start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def test_replay_after_a_kill_between_write_and_publish(spark, tmp_path):
    stream = batches(spark, tmp_path / "in", [[(1, "a")], [(2, "b")], [(3, "c")]], "id long, v string")
    ledger, died = Ledger(spark, str(tmp_path / "out")), []

    def kill(batch):
        if batch == 1 and not died:
            died.append(batch)
            raise Killed

    with pytest.raises(Exception, match="Killed"):
        run(to_ledger(stream, ledger, str(tmp_path / "ck"), "s", after_stage=kill))
    assert died == [1] and [r.id for r in ledger.read().collect()] == [1]
    run(to_ledger(stream, ledger, str(tmp_path / "ck"), "s", after_stage=kill))
    assert sorted(r.id for r in ledger.read().collect()) == [1, 2, 3]
    assert ledger.sweep() == 1 and ledger.read().count() == 3
    # The checkpoint is lost, so all batches come again under their ids: none is taken twice.
    run(to_ledger(stream, ledger, str(tmp_path / "ck2"), "s"))
    assert sorted(r.id for r in ledger.read().collect()) == [1, 2, 3]
    # After the commit, before the checkpoint knows: the same batch is passed over.
    publish_batch(ledger, "s")(spark.createDataFrame([(2, "b")], "id long, v string"), 1)
    assert ledger.read().count() == 3


def test_complete_and_update_modes(spark, tmp_path):
    parts = [[("a", 1), ("b", 1)], [("a", 5)], [("c", 2)]]
    stream = batches(spark, tmp_path / "in", parts, "k string, v long")
    counts = stream.groupBy("k").agg(F.sum("v").alias("s"))
    whole, latest = Ledger(spark, str(tmp_path / "whole")), Ledger(spark, str(tmp_path / "latest"))
    run(to_ledger(counts, whole, str(tmp_path / "c1"), "s", "complete"))
    run(to_ledger(counts, latest, str(tmp_path / "c2"), "s", "update"))
    want = [("a", 6), ("b", 1), ("c", 2)]
    assert sorted((r.k, r.s) for r in whole.read().collect()) == want
    assert sorted((r.k, r.s) for r in latest.newest(["k"]).collect()) == want
    assert len(whole.versions()) == 3 and sorted(r.k for r in latest.read().collect()) == ["a", "a", "b", "c"]


def test_two_writers(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "t"))
    assert ledger.read() is None and ledger.read("k long").count() == 0
    both, added = threading.Barrier(2), {}

    def write(name, low):
        first = [True]

        def meet():
            if first:
                first.clear()
                both.wait(60)  # both have read the same versions

        rows = spark.range(low, low + 100).withColumn("by", F.lit(name))
        added[name] = Ledger(spark, str(tmp_path / "t")).append_new(rows, ["id"], before_commit=meet)

    threads = [threading.Thread(target=write, args=x) for x in (("one", 0), ("two", 50))]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    assert sorted(added.values()) == [50, 100]
    assert sorted(r.id for r in ledger.read().collect()) == list(range(150))
    assert ledger.append_new(spark.range(0, 10).withColumn("by", F.lit("x")), ["id"]) == 0
    with pytest.raises(Conflict):
        ledger.commit(0, {})
    assert [e["rows"] for e in ledger.versions()] == [100, 50]


def test_time_alone_stops_a_target_and_frees_it(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "target string, attempt int, pos int, smiles string"
    stream = batches(spark, tmp_path / "in", [[("t", 1, 1, "a"), ("u", 1, 1, "x"), ("u", 1, 2, "y")]], schema)
    out = collect.collect_within_clock(stream, 2, 3, 4.0)
    q = out.writeStream.format("memory").queryName("clocked").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        until = time.time() + 90
        rows = []
        while time.time() < until:
            rows = [(r.target, r.smiles, r.total, r.stopped, r.reason) for r in spark.table("clocked").collect()]
            states = [s.numRowsTotal for p in q.recentProgress[-1:] for s in p.stateOperators]
            if ("t", None, 1, True, "time") in rows and states and states[0] == 0:
                break
            time.sleep(0.5)
    finally:
        q.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert sorted(rows, key=str) == sorted([("t", "a", 1, False, None), ("u", "x", 1, True, None), ("u", "y", 2, True, None), ("u", None, 2, True, "enough"), ("t", None, 1, True, "time")], key=str)
    assert states == [0]
