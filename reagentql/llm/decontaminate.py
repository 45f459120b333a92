"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over consecutive tokens; the tokens at its ones are hashed and
those at its zeros ignored, so a substituted word spoils only the seeds that look at it.
The hashes of all benchmark items form a sorted table (in blocks of bounded size), every
document's hashes are joined with it by binary search, and the hits are verified by aligning
item and document around them, each alignment once.

The masks are chosen so that no match is missed: every stretch of tokens that counts as a match
holds, at some place, all tokens that one of its item's masks looks at (see ``masks_for``).
"""

from __future__ import annotations

import functools
import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reagentql.llm.common import BoundedCache, Scratch, id_and_text, map_texts

TOKEN = re.compile(r"[^\W_]+")
#: Masks of five looked-at tokens.  A stretch of at least nine equal tokens, three quarters of it or more, holds one of them wherever its other tokens stand.
MASKS = ("11111", "1110011", "110100101", "111010001")
#: A match needs this many equal tokens in its best stretch (IDENTITY of an item's tokens if that is less), at this share of it.
MATCHED, IDENTITY = 12, 0.75
#: Items of fewer tokens than this are matched as a whole, and those of four or more may lose one token.
SHORT = 11
#: Benchmark characters that are matched in one pass over the documents: a table of about 250 MB at most.
BLOCK_CHARS = 16_000_000
#: Hits that are expanded, and tokens that are aligned, at a time.
HITS, ALIGNED = 1 << 20, 1 << 21


def token_hash(token: str) -> int:
    return xxhash.xxh64_intdigest(token, 7) | 1


@functools.lru_cache(1)
def token_cache() -> BoundedCache:
    return BoundedCache(token_hash, 200_000)


def token_hashes(text: str, cache: dict | None = None) -> np.ndarray:
    cache = token_cache() if cache is None else cache
    return np.array([cache[t] for t in TOKEN.findall(text.lower())], np.uint64)


def seed_hashes(tokens: np.ndarray, mask: str) -> np.ndarray:
    """A hash per start of the tokens that the mask looks at."""
    n = len(tokens) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, int("1" + mask, 2) * 0x9E3779B97F4A7C15 & (1 << 64) - 1, np.uint64)
    for at in (i for i, c in enumerate(mask) if c == "1"):
        out = (out ^ tokens[at : at + n]) * np.uint64(0xFF51AFD7ED558CCD)
        out ^= out >> np.uint64(32)
    return out


def masks_for(n: int) -> tuple[str, ...]:
    """The masks of an item of n tokens, of which every match of it holds one.

    From SHORT tokens on the fixed ones.  An item of six to ten tokens that loses one keeps a half
    whole, one of four or five is hashed without each of its tokens in turn, and shorter ones whole.
    """
    if n >= SHORT:
        return MASKS
    if n >= 6:
        return ("1" * (n // 2),)
    if n >= 4:
        return ("1" * (n - 1), *["1" * i + "0" + "1" * (n - 1 - i) for i in range(1, n - 1)])
    return ("1" * n,)


def starts_for(n: int, mask: str) -> range | list[int]:
    """Where a mask is laid in an item of n tokens: everywhere, or for short items at both ends."""
    last = n - len(mask)
    return range(last + 1) if n >= SHORT else sorted({0, last})


def needed(n: np.ndarray) -> np.ndarray:
    """Equal tokens that an item of n tokens needs: of short ones all, or all but one from four tokens on."""
    return np.where(n < SHORT, np.where(n < 4, n, n - 1), np.minimum(MATCHED, np.ceil(IDENTITY * n))).astype(np.int64)


def whole_stretches(equal: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and matches of the stretch from the first to the last equal token, per alignment."""
    first = np.cumsum(lengths) - lengths
    at = np.arange(len(equal))
    matches = np.add.reduceat(equal.astype(np.int64), first)
    start = np.minimum.reduceat(np.where(equal, at, len(equal)), first) - first
    end = np.maximum.reduceat(np.where(equal, at + 1, 0), first) - first
    return np.where(matches > 0, start, 0), np.where(matches > 0, end, 0), matches


def best_stretches(equal: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and matches of the stretch with the most matches less mismatches, per alignment.

    ``equal`` has the alignments one after another, none of them empty.  Of equal stretches the
    one that ends first counts, from the earliest start.
    """
    # Each alignment gets a place before its first token, with a total of zero.
    first = np.cumsum(lengths + 1) - lengths - 1
    of = np.repeat(np.arange(len(lengths)), lengths + 1)
    step = np.zeros(len(of), np.int64)
    inner = np.ones(len(of), bool)
    inner[first] = False
    step[inner] = np.where(equal, 1, -1)
    total = np.cumsum(step)
    total -= total[first][of]
    lift = of * (2 * int(lengths.max()) + 2)
    lowest = np.minimum.accumulate(total - lift) + lift
    gain = total - lowest
    most = np.maximum.reduceat(gain, first)
    at = np.flatnonzero(gain == most[of])
    end = at[np.searchsorted(of[at], np.arange(len(lengths)))]
    lows = np.flatnonzero(total == lowest[end][of])
    start = lows[np.searchsorted(of[lows], np.arange(len(lengths)))]
    matches = ((end - start) + (total[end] - total[start])) // 2
    return start - first, end - first, matches


class SeedTable:
    """The seeds of one block of benchmark items, as arrays sorted by hash."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        items = [(i, t) for i, t in items if len(t)]
        self.ids = np.array([i for i, _ in items], np.int64)
        self.length = np.array([len(t) for _, t in items], np.int64)
        self.first = np.cumsum(self.length) - self.length
        self.tokens = np.concatenate([t for _, t in items]) if items else np.zeros(0, np.uint64)
        parts, self.masks = [], sorted({m for n in self.length.tolist() for m in masks_for(n)})
        for mask in self.masks:
            for k in np.flatnonzero([mask in masks_for(n) for n in self.length.tolist()]).tolist():
                starts = np.array(starts_for(len(items[k][1]), mask), np.int32)
                h = seed_hashes(items[k][1], mask)[starts]
                parts.append((h, np.full(len(h), k, np.int32), starts))
        h, item, at = (np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, np.uint64), *[np.zeros(0, np.int32)] * 2)
        order = np.argsort(h, kind="stable")
        self.hash, self.item, self.at = h[order], item[order], at[order]
        self.shift = np.uint64(64 - min(24, max(20, int(len(h)).bit_length() + 3)))
        self.maybe = np.zeros(1 << int(np.uint64(64) - self.shift), bool)
        self.maybe[self.hash >> self.shift] = True

    def _hits(self, tokens: np.ndarray):
        """Alignments (item, shift) of the seeds that document and items share, a bounded number of hits at a time."""
        found = []
        for mask in self.masks:
            hashes = seed_hashes(tokens, mask)
            p = np.flatnonzero(self.maybe[hashes >> self.shift])
            if len(p):
                low = np.searchsorted(self.hash, hashes[p])
                n = np.searchsorted(self.hash, hashes[p], "right") - low
                found.append((p[n > 0], low[n > 0], n[n > 0]))
        if not found:
            return
        p, low, n = (np.concatenate(c) for c in zip(*found))
        order = np.argsort(p, kind="stable")
        p, low, n = p[order], low[order], n[order]
        # Pieces of one seed's items, should it have more than HITS.
        pieces = (n - 1) // HITS + 1
        part = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        p, low, n = np.repeat(p, pieces), np.repeat(low, pieces) + part * HITS, np.minimum(np.repeat(n, pieces) - part * HITS, HITS)
        piece = np.cumsum(n) // HITS
        for at in np.split(np.arange(len(p)), np.flatnonzero(np.diff(piece)) + 1):
            if len(at):
                times = n[at]
                of = np.repeat(low[at], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                shift = np.repeat(p[at], times) - self.at[of]
                both = np.unique(self.item[of].astype(np.int64) << 32 | shift + (1 << 31))
                yield both >> 32, (both & (1 << 32) - 1) - (1 << 31)

    def _aligned(self, tokens, item, shift):
        """(row of item, start, end, item_start, matches) of the alignments that are matches."""
        low, high = np.maximum(0, -shift), np.minimum(self.length[item], len(tokens) - shift)
        for at in np.split(np.arange(len(item)), np.flatnonzero(np.diff(np.cumsum(high - low) // ALIGNED)) + 1):
            if len(at):
                lengths = (high - low)[at]
                inside = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                here = np.repeat((low + shift)[at], lengths) + inside
                there = np.repeat((self.first[item] + low)[at], lengths) + inside
                equal = tokens[here] == self.tokens[there]
                best, whole = best_stretches(equal, lengths), whole_stretches(equal, lengths)
                start, end, matches = (np.where(self.length[item[at]] < SHORT, w, b) for w, b in zip(whole, best))
                good = (matches >= needed(self.length[item[at]])) & (matches >= IDENTITY * (end - start))
                yield from zip(*(c[good].tolist() for c in (item[at], (low + shift)[at] + start, (low + shift)[at] + end, low[at] + start, matches)))

    def find(self, tokens: np.ndarray) -> list[tuple[int, int, int, int, int, float]]:
        """(item, start, end, item_start, matches, identity) of the best stretch for each item found.

        Best is the one with the most matches, then the first in the document, then in the item.
        """
        best: dict[int, tuple] = {}
        for item, shift in self._hits(tokens):
            for k, start, end, there, matches in self._aligned(tokens, item, shift):
                row = -matches, start, there, end
                if k not in best or row < best[k]:
                    best[k] = row
        rows = [(int(self.ids[k]), a, b, t, -m, -m / (b - a)) for k, (m, a, t, b) in best.items()]
        return sorted(rows, key=lambda r: (r[0], r[1], r[3]))

    def any(self, tokens: np.ndarray) -> bool:
        """Whether some item is found."""
        return any(True for item, shift in self._hits(tokens) for _ in self._aligned(tokens, item, shift))


def seed_tables(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_chars: int = BLOCK_CHARS):
    """Functions that give the benchmark as seed tables of bounded size, one each.

    The benchmark is the query set: it is dealt into blocks by hash of its ids, and each
    block is matched against all documents.  Items without an id take no part; repeated rows
    are one item.
    """
    items = id_and_text(benchmark, id_col, text_col).where(F.col("doc_id").isNotNull())
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, math.ceil(chars / block_chars))

    def build(k):
        cache = BoundedCache(token_hash, 500_000)
        rows = items.where(F.pmod(F.xxhash64("doc_id"), F.lit(n)) == k).distinct().orderBy("doc_id", "text").collect()
        return SeedTable([(r["doc_id"], token_hashes(r["text"], cache)) for r in rows])

    return [functools.partial(build, k) for k in range(n)]


FOUND = ("doc_id", "item_id", "start", "end", "item_start", "matches", "identity")


def _search(rows: DataFrame, shared, column: str, kind: str) -> DataFrame:
    """The items of a broadcast table in documents given as text or as token hashes."""

    def run(batches):
        table = shared.value
        for batch in batches:
            which, found = [], []
            for i, value in enumerate(batch.column(column).to_pylist()):
                tokens = token_hashes(value) if column == "text" else np.frombuffer(value, np.uint64)
                for row in table.find(tokens):
                    which.append(i)
                    found.append(row)
            columns = list(zip(*found)) or [()] * 6
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(which, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds))], FOUND
            )

    return rows.mapInArrow(run, f"doc_id {kind}, item_id long, start int, end int, item_start int, matches int, identity double")


def benchmark_overlaps(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """doc_id, item_id, start, end, item_start, matches, identity: one row per document and item found in it.

    Positions are tokens, ends exclusive.  An item is found wherever its best ungapped stretch
    has at least 12 equal tokens (three quarters of a shorter item's) and three quarters of the
    stretch are equal.  An item under 11 tokens is found where it stands whole, or with one token
    changed if it has four or more.  No such place is missed.  Of several such stretches the one with the most
    equal tokens is given, then the first.  Null and empty texts and items match nothing; rows
    repeated in ``docs`` give repeated results; an empty benchmark or table gives no rows; texts of
    any length are searched whole.

    Where the benchmark has several blocks, documents are tokenised once into a table of their
    own, and only one block's table is held at a time.
    """
    rows = id_and_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    context, tables = docs.sparkSession.sparkContext, seed_tables(benchmark, block_chars=block_chars)
    if len(tables) == 1:
        return _search(rows, context.broadcast(tables[0]()), "text", kind)

    def make():
        def run(ids, texts):
            yield pa.RecordBatch.from_arrays([ids, pa.array([token_hashes(t).tobytes() for t in texts], pa.binary())], ["doc_id", "tokens"])

        return run

    scratch = Scratch(docs.sparkSession)
    tokens, out = scratch.spill(map_texts(rows, make, f"doc_id {kind}, tokens binary")), None
    for build in tables:
        shared = context.broadcast(build())
        part = scratch.spill(_search(tokens, shared, "tokens", kind))
        shared.destroy()
        out = part if out is None else out.union(part)
    return scratch.last(out)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no benchmark item is found.

    Null and empty texts stay; rows that repeat a text stay or go together; an empty benchmark
    drops nothing; an empty table gives no rows.
    """
    context, tables = docs.sparkSession.sparkContext, seed_tables(benchmark, block_chars=block_chars)
    if len(tables) > 1:
        # Rows are settled and numbered, so that each is dropped for itself, whatever ids and texts they repeat.
        rows = Scratch(docs.sparkSession).spill(docs.withColumn("__row", F.monotonically_increasing_id()))
        gone = benchmark_overlaps(rows, benchmark, "__row", text_col, block_chars).select(F.col("doc_id").alias("__row")).distinct()
        return rows.join(gone, "__row", "left_anti").select(*docs.columns)
    shared = context.broadcast(tables[0]())

    def run(batches):
        table = shared.value
        for batch in batches:
            keep = [not table.any(token_hashes(t or "")) for t in batch.column(text_col).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
