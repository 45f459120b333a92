"""Streaming forms: distinct candidates until enough, windowed counts, idempotent batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

STATE = "seen array<string>, dry int, stopped boolean, attempt long"
OUT = "target string, smiles string, total int, dry int, stopped boolean"


def advance(held: tuple, rows: pd.DataFrame, enough: int, stop_after: int) -> tuple[tuple, list[tuple[str, int]]]:
    """What is held of a target (candidates, dry attempts, stopped, last attempt) after more rows, and the new candidates with their numbers."""
    # ``dry``: dry attempts in a row, the one at hand included as long as it has found nothing.
    seen, dry, stopped, attempt = held
    seen, out = list(seen), []
    known = set(seen)
    for number, part in rows.sort_values(["attempt", "pos"]).groupby("attempt", sort=True):
        number = int(number)
        if attempt is None or number > attempt:
            stopped = stopped or dry >= stop_after or (attempt is not None and dry + number - attempt - 1 >= stop_after)
            dry, attempt = dry + (1 if attempt is None else number - attempt), number
        if stopped:
            break
        before = len(seen)
        for s in part["smiles"]:
            if s not in known and len(seen) < enough:
                known.add(s)
                seen.append(s)
                out.append((s, len(seen)))
        dry = 0 if len(seen) > before else dry
        stopped = len(seen) >= enough
    return (seen, dry, stopped, attempt), out


def collect_until_enough(rows: DataFrame, enough: int, stop_after: int) -> DataFrame:
    """New distinct candidates per target until ``enough`` are known or ``stop_after`` attempts in a row had none.

    ``rows`` is a stream of target, attempt, pos, smiles.  Within a micro-batch rows are put in
    order of attempt and position, so arrival order does not matter.  An attempt may go on in the
    next micro-batch: whether it was dry is settled when a later attempt comes.  Attempt numbers
    that are skipped had no candidates and count as dry.  State is bounded by ``enough`` candidates
    a target.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else ([], 0, False, None)
        held, found = advance(held, pd.concat(list(frames)), enough, stop_after)
        state.update(held)
        _, dry, stopped, _ = held
        yield pd.DataFrame([(key[0], s, n, dry, stopped) for s, n in found], columns=["target", "smiles", "total", "dry", "stopped"])

    return rows.groupBy("target").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


class ClockedCollector(StatefulProcessor):
    """Collects as ``advance`` does, and stops a target when its time is up, rows or no rows."""

    def __init__(self, enough: int, stop_after: int, millis: int):
        self.enough, self.stop_after, self.millis = enough, stop_after, millis

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", STATE)

    def _rows(self, key: tuple, found: list, held: tuple, reason: str | None) -> pd.DataFrame:
        rows = [(key[0], s, n, held[1], held[2], None) for s, n in found]
        if reason:
            rows.append((key[0], None, len(held[0]), held[1], True, reason))
        return pd.DataFrame(rows, columns=["target", "smiles", "total", "dry", "stopped", "reason"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        parts = [r for r in rows if len(r)]
        if not parts:
            return
        if self.held.exists():
            held = self.held.get()
        else:
            held = [], 0, False, None
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.millis)
        if held[2]:
            return  # stopped before; only the clock is waited for
        held, found = advance(tuple(held), pd.concat(parts), self.enough, self.stop_after)
        # What a stopped target holds is no longer needed, only that it has stopped.
        self.held.update(([] if held[2] else held[0], held[1], held[2], held[3]))
        yield self._rows(key, found, held, "enough" if len(held[0]) >= self.enough else "dry" if held[2] else None)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = tuple(self.held.get())
        self.held.clear()
        if not held[2]:
            yield self._rows(key, [], held, "time")

    def close(self) -> None:
        pass


def collect_within_clock(rows: DataFrame, enough: int, stop_after: int, seconds: float) -> DataFrame:
    """As ``collect_until_enough``, and each target stops ``seconds`` after its first row, even if nothing more comes.

    Besides the candidates a row without one says when a target stops, and why (``reason``: enough,
    dry or time).  A target's state is freed when its time is up, whether it stopped before or
    not; until then rows of a stopped target are passed over, later ones begin anew.  The stream
    needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    collector = ClockedCollector(enough, stop_after, round(seconds * 1000))
    return rows.groupBy("target").transformWithStateInPandas(collector, f"{OUT}, reason string", "Append", "ProcessingTime")


RESPONSE = "target string, attempt int, pos int, response string"


def response_stream(spark: SparkSession, folder: str, files_a_batch: int = 1000, schema: str = RESPONSE) -> DataFrame:
    """Recorded responses (JSON lines) as they come into a folder, at most so many files a batch.

    Spark's own file source keeps the offsets: which files a batch has taken stands in the
    query's checkpoint, so a restarted query goes on where it ended, with nothing lost or repeated
    if its sink knows its batches (``sources.ledger``).  Lines that are no JSON have null fields.
    """
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).json(folder)


def distinct_within(rows: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """Duplicates dropped while they arrive within the watermark; the state stays bounded."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(rows: DataFrame, time: str, size: str, slide: str | None, delay: str, by: list[str]) -> DataFrame:
    """Counts per tumbling or sliding window; rows later than the watermark are left out."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return rows.withWatermark(time, delay).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def to_idempotent_sink(rows: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """A writer that hands each micro-batch with its id to ``write``; replays carry the same id."""
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
