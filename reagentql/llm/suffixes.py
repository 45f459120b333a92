"""Repeated passages by sparse suffix arrays.

Of the suffixes (by word) of every document only those at minimiser positions are kept:
the places where the hash of the next ``KEY`` words is the least of ``WINDOW`` places in a
row.  Equal passages choose equal places, and every passage of WINDOW + KEY - 1 = 50 words
holds at least one.  Suffixes whose first KEY words occur in several documents are sorted
by what follows them (and once more by what precedes them, backwards), neighbours in that
order are compared, and each match is extended to the right and left.  Kept suffixes of a
document are closer together than their keys are long, so the matches of a long passage
join without gaps.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reagentql.llm.common import BoundedCache, Scratch, id_and_text, join_on_hot, map_texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KEY, WINDOW = 27, 24
LEAST = KEY + WINDOW - 1
#: Words around a key that can lie outside the keys of a passage.
REACH = WINDOW - 1
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Rows that are compared at a time; a longer group of one key is held as 20 bytes a row.
HELD = 100_000


@functools.lru_cache(1)
def word_cache() -> BoundedCache:
    return BoundedCache(lambda w: xxhash.xxh64_intdigest(w, 11), 500_000)


def word_hashes(text: str) -> np.ndarray:
    cache = word_cache()
    return np.array([cache[w] for w in WORD.findall(text)], np.uint64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def key_hashes(words: np.ndarray, size: int = KEY) -> np.ndarray:
    """A well-mixed hash of each run of ``size`` words."""
    n = len(words)
    if n < size:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * powers(BASE, n), out=sums[1:])
    h = (sums[size:] - sums[:-size]) * powers(INVERSE, n - size + 1)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def anchors(keys: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of the least key of every ``window`` positions in a row, the leftmost of equals."""
    if len(keys) < window:
        return np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(keys, window)
    return np.unique(views.argmin(1) + np.arange(len(views)))


def _kept_suffixes(rows: DataFrame) -> DataFrame:
    def make():
        def run(ids, texts):
            which, at, key = [], [], []
            for i, text in enumerate(texts):
                keys = key_hashes(word_hashes(text))
                chosen = anchors(keys)
                which.append(np.full(len(chosen), i))
                at.append(chosen)
                key.append(keys[chosen].view(np.int64))
            which = np.concatenate(which)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(key)), ids.take(pa.array(which)), pa.array(np.concatenate(at), pa.int32())],
                ["key", "doc_id", "at"],
            )

        return run

    return map_texts(rows, make, "key long, doc_id long, at int")


def _with_surroundings(rows: DataFrame) -> DataFrame:
    """The kept suffixes with the words after their keys and, backwards, before them, as hashes."""

    def run(batches):
        for batch in batches:
            out = [], [], [], [], []
            for doc_id, text, chosen in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "text", "chosen"))):
                words = word_hashes(text)
                keys = key_hashes(words).view(np.int64)
                short = (words >> np.uint64(32)).astype(">u4") | np.uint32(1)  # never the padding 0
                back = short[::-1]
                for s in chosen:
                    a, end = s["at"], s["at"] + KEY
                    n = len(words)
                    if a >= len(keys) or keys[a] != s["key"]:
                        continue  # of another text with this id
                    for column, value in zip(
                        out,
                        (s["key"], doc_id, a, short[end : end + REACH].tobytes(), back[n - a : n - a + REACH].tobytes()),
                    ):
                        column.append(value)
            kinds = pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["key", "doc_id", "at", "after", "before"])

    return rows.mapInArrow(run, "key long, doc_id long, at int, after binary, before binary")


def padded(runs: pa.Array) -> np.ndarray:
    """Runs of four-byte hashes as rows of REACH numbers, 0 where a run has ended."""
    data = runs.to_pylist()
    lengths = np.fromiter(map(len, data), np.int64, len(data)) // 4
    out = np.zeros((len(data), REACH), np.uint32)
    out[np.arange(REACH) < lengths[:, None]] = np.frombuffer(b"".join(data), np.uint32)
    return out


def common_words(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal leading words of each two rows of padded runs."""
    return np.where((a != b) | (a == 0), np.arange(a.shape[1]), a.shape[1]).min(1, initial=a.shape[1])


def _least_from_left(steps: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The running minimum of steps (0 to REACH) within each group; groups are numbered upwards."""
    lift = group * (REACH + 1)
    return np.minimum.accumulate(steps - lift) + lift


def neighbours(key, doc, step, open_left: bool, open_right: bool):
    """The longest run each row shares with a row of another document, of rows sorted by key and run.

    ``step`` is the common run with the row before.  Common runs only shrink along the order,
    so the nearest row of another document on either side has the longest.  Also given, for
    rows whose nearest such row may lie before the first (or after the last) row: the words
    shared with that first (last) row; -1 for the others.
    """
    n = len(key)
    new_key = np.concatenate([[True], key[1:] != key[:-1]])
    start = new_key | np.concatenate([[True], doc[1:] != doc[:-1]])
    group = np.cumsum(start) - 1
    left = _least_from_left(np.where(new_key, 0, step), group)
    after = np.append(np.where(new_key[1:], 0, step[1:]), 0)
    right = _least_from_left(after[::-1], (group[-1] - group)[::-1])[::-1]
    from_left, from_right = np.full(n, -1), np.full(n, -1)
    if open_left:
        first = group == 0
        from_left[first] = np.minimum.accumulate(np.append(REACH, step[first][1:]))
    if open_right:
        last = group == group[-1]
        from_right[last] = np.minimum.accumulate(np.append(REACH, step[last][1:][::-1]))[::-1]
    return left, right, from_left, from_right


ROW = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int32()), ("ext", pa.int32()), ("from_left", pa.int32()), ("from_right", pa.int32()), ("part", pa.int32()), ("edge", pa.binary())])


def _compare(batches, name: str, part: int):
    """Each suffix's longest run in common with another document, among the rows of one partition.

    The partition's first and last suffix come once more as edges, with their run and, as ext,
    what they share with the nearest other document after (before) them.
    """
    def pack(key, doc, at, ext, left, right, edges=None):
        columns = key, doc, at, ext, left, right, np.full(len(key), part)
        runs = pa.nulls(len(key), pa.binary()) if edges is None else pa.array(edges, pa.binary())
        return pa.RecordBatch.from_arrays([*(pa.array(c).cast(f.type) for c, f in zip(columns, ROW)), runs], schema=ROW)

    def emit(held, first, last):
        key, doc, at, step = (np.concatenate(c) for c in zip(*held))
        left, right, from_left, from_right = neighbours(key, doc, step, first, last)
        yield pack(key, doc, at, np.maximum(left, right), from_left, from_right)
        for here, i, value in ((first, 0, right), (last, -1, left)):
            if here:
                one = slice(i, None) if i else slice(0, 1)
                yield pack(key[one], doc[one], at[one], value[one], from_left[one], from_right[one], [runs[i]])

    held, first, before, runs = [], True, None, [b"", b""]
    for batch in batches:
        if not batch.num_rows:
            continue
        key, doc, at = (batch.column(n).to_numpy() for n in ("key", "doc_id", "at"))
        words = padded(batch.column(name))
        step = np.append(0 if before is None else common_words(before, words[:1]), common_words(words[:-1], words[1:]))
        if before is None:
            runs[0] = batch.column(name)[0].as_py()
        before, runs[-1] = words[-1:], batch.column(name)[batch.num_rows - 1].as_py()
        held.append((key, doc, at, step))
        if sum(len(h[0]) for h in held) < HELD or held[0][0][0] == key[-1]:
            continue
        columns = [np.concatenate(c) for c in zip(*held)]
        end = int(np.searchsorted(columns[0], key[-1]))
        yield from emit([[c[:end] for c in columns]], first, False)
        held, first = [[c[end:] for c in columns]], False
    if held:
        yield from emit(held, first, True)


def joined_edges(edges: list) -> list[tuple[int, int, int]]:
    """(part, left, right): what the rows of each part share with the nearest other document outside it.

    ``edges`` has first and last (key, doc_id, ext, from_left, from_right, part, edge) of each part, in order.
    A value holds for rows that reach that end of the part (from_left, from_right).
    """

    def walk(pairs, open_of):
        out, key, doc, run, shared = {}, None, None, None, 0
        for near, far in pairs:
            into = 0
            if near["key"] == key:
                common = int(common_words(padded(pa.array([run], pa.binary())), padded(pa.array([near["edge"]], pa.binary())))[0])
                into = common if near["doc_id"] != doc else min(common, shared)
            out[near["part"]] = into
            key, doc, run = far["key"], far["doc_id"], far["edge"]
            # A part of one document and key only passes on what came in.
            shared = far["ext"] if far[open_of] < 0 else min(into, far[open_of])
        return out

    pairs = [(edges[i], edges[i + 1]) for i in range(0, len(edges), 2)]
    left = walk(pairs, "from_left")
    right = walk([(b, a) for a, b in reversed(pairs)], "from_right")
    return [(p, left[p], right[p]) for p in left]


def _extend(around: DataFrame, name: str, scratch: Scratch) -> DataFrame:
    """key, doc_id, at, ext: words by which each suffix's match reaches beyond its key on one side."""
    rows = around.select("key", "doc_id", "at", name)
    order = ["key", name, "doc_id", "at"]
    spark = around.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    kinds = "key long, doc_id long, at int, ext int, from_left int, from_right int, part int, edge binary"
    found = scratch.spill(dealt.mapInArrow(lambda b: _compare(b, name, TaskContext.get().partitionId()), kinds))
    # Two edges a partition.
    edges = [r.asDict() for r in found.where("edge IS NOT NULL").collect()]
    edges.sort(key=lambda r: (r["part"], r["key"], r["edge"], r["doc_id"], r["at"]))
    ends = spark.createDataFrame(joined_edges(edges), "part int, left int, right int")
    both = found.where("edge IS NULL").join(F.broadcast(ends), "part", "left")
    ext = F.greatest("ext", F.least("left", "from_left"), F.least("right", "from_right")).cast("int")
    return both.select("key", "doc_id", "at", ext.alias("ext"))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, end, n_words, first_doc: passages of 50 or more words that occur in other documents too.

    Positions count words (runs without white space), ends exclusive.  Every word of a
    passage lies in a run of at least 27 words that another document shares.  ``first_doc``
    is the smallest id among the documents that share any of the passage's keys: where it is
    the row's own id, the passage is not a later copy.  Null, empty and short texts have no
    passages; ids must be whole numbers (rows without one have none).  Rows that repeat an id
    are one document, whose passages are those of all its texts, by position.  An empty table
    gives no rows.
    """
    rows = id_and_text(docs, id_col, text_col)
    scratch = Scratch(docs.sparkSession)
    kept = scratch.spill(_kept_suffixes(rows).where("doc_id IS NOT NULL"))
    several = kept.groupBy("key").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.count("*").alias("n"))
    several = scratch.spill(several.where("first_doc < last_doc").select("key", "first_doc", "n"))
    shared = scratch.spill(join_on_hot(kept, several, "key", kept.count()))
    chosen = shared.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("at", "key"))).alias("chosen"))
    around = scratch.spill(_with_surroundings(rows.join(chosen, "doc_id").select("doc_id", "text", "chosen")))
    parts = [
        _extend(around, "after", scratch).select("doc_id", "at", F.lit(0).alias("left"), F.col("ext").alias("right")),
        _extend(around, "before", scratch).select("doc_id", "at", F.col("ext").alias("left"), F.lit(0).alias("right")),
        shared.select("doc_id", "at", F.lit(0).alias("left"), F.lit(0).alias("right")),
    ]
    spans = parts[0].union(parts[1]).union(parts[2]).groupBy("doc_id", "at").agg(F.max("left").alias("left"), F.max("right").alias("right"))
    spans = spans.join(shared.groupBy("doc_id", "at").agg(F.min("first_doc").alias("first_doc")), ["doc_id", "at"])
    spans = spans.select("doc_id", (F.col("at") - F.col("left")).alias("start"), (F.col("at") + KEY + F.col("right")).alias("end"), "first_doc")
    # Spans that touch are one passage.
    order = Window.partitionBy("doc_id").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.coalesce((F.col("start") > before).cast("int"), F.lit(1)))
    spans = spans.withColumn("passage", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = spans.groupBy("doc_id", "passage").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("first_doc").alias("first_doc"))
    merged = merged.withColumn("n_words", F.col("end") - F.col("start")).where(F.col("n_words") >= LEAST)
    return scratch.last(merged.select("doc_id", "start", "end", "n_words", "first_doc"))
