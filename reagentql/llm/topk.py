"""Exact top-k by inner product, term at a time.

Vectors of whole numbers are sparse rows over their dimensions.  Candidates and queries
are packed into blocks that hold a bounded count of numbers, whatever the width of the vectors; each pair of blocks is one row of a join whose
keys are unique on both sides, so no pair is hot.  In a pair every query scatters its
weighted postings into a dense score array of a tile of candidates that fits a core's cache,
selects its best k, and the selections of tiles, then of blocks, are merged.

A table of n candidates and m queries in blocks of b vectors sends 2 * n * m / b vectors through
the exchange, so blocks are as large as a task holds with ease: NUMBERS of 8 bytes each, 8 MB a
side, as one Arrow row that numpy reads in place.  A task holds two blocks, their postings and the
scores of a tile, about 40 MB at any width.  Where that would leave cores idle, candidates are
dealt into more blocks, down to one tile each.

Products are summed in 32, 64 or, where a sum could pass 63 bits, in Python's whole numbers,
so none of them wraps.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from reagentql.llm.common import cut


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, scale: float = 64.0) -> DataFrame:
    """vec_id, v: floor(scale * x) of every component; vectors null or with null or non-finite parts drop out."""
    x = F.transform(F.col(vector_col), lambda e: e.cast("double"))
    good = F.col("x").isNotNull() & F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where(F.coalesce(good, F.lit(False)) & F.col("vec_id").isNotNull())
    return rows.select("vec_id", F.transform("x", lambda e: F.floor(e * scale).cast("long")).alias("v"))


#: Numbers in a block and in a tile of candidates: 16,384 and 4,096 vectors of 64.
NUMBERS, TILE_NUMBERS = 1 << 20, 1 << 18


def _blocks(rows: DataFrame, count: int, size: int, name: str, least: int = 1, tile: int = 1) -> tuple[DataFrame, int]:
    """Blocks of about ``size`` rows, or ``least`` blocks if they hold a ``tile`` each: their number and name, ids, vectors."""
    n = max(1, math.ceil(count / size), min(least, math.ceil(count / tile)))
    part = F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias(name)
    packed = rows.select(part, F.struct("vec_id", "v").alias("r")).groupBy(name).agg(F.sort_array(F.collect_list("r")).alias(f"{name}_rows"))
    return packed, n


def matrix(lists: pa.ListArray) -> np.ndarray:
    """Lists of whole numbers as the rows of a matrix, with zeros after the shorter ones."""
    offsets = lists.offsets.to_numpy()
    width = np.diff(offsets)
    values = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    if len(width) and (width == width[0]).all():
        return values.reshape(len(width), int(width[0]))
    out = np.zeros((len(width), int(width.max(initial=0))), np.int64)
    row = np.repeat(np.arange(len(width)), width)
    out[row, np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], width)] = values
    return out


def _largest(x: np.ndarray) -> int:
    return max(int(x.max()), -int(x.min())) if x.size else 0


def best_of_block(q_ids: np.ndarray, queries: np.ndarray, c_ids: np.ndarray, candidates: np.ndarray, k: int) -> tuple[list, list, list]:
    """For each query its k best of the candidates (sorted by id), own id excepted, as query, id and score columns."""
    dims = candidates.shape[1]
    postings = []
    for row in np.ascontiguousarray(candidates.T):
        used = np.flatnonzero(row)
        postings.append((None, row) if len(used) * 4 > len(row) else (used, row[used]))
    big = _largest(queries) * _largest(candidates) * max(dims, 1)
    kind = np.int32 if big < 2**31 else np.int64 if big < 2**63 else object
    postings = [(at, w.astype(kind)) for at, w in postings]
    n, out_q, out_c, out_s = len(candidates), [], [], []
    order = np.arange(n - 1, -1, -1, dtype=np.int64)  # smaller ids win ties
    for q, v in zip(q_ids.tolist(), queries):
        scores = np.zeros(n, kind)
        for t, x in enumerate(v[:dims].tolist()):
            if x:
                at, w = postings[t]
                if at is None:
                    scores += w * np.array(x, kind)
                else:
                    scores[at] += w * np.array(x, kind)
        if big < 2**40:
            rank = scores.astype(np.int64) * n + order
            own = np.searchsorted(c_ids, q)
            if own < n and c_ids[own] == q:
                rank[own] = np.iinfo(np.int64).min
            top = np.argpartition(rank, max(0, n - k))[max(0, n - k) :] if n > k else np.arange(n)
            top = top[np.argsort(-rank[top])]
        else:
            if kind is object:
                scores = np.array([min(max(s, -(2**63)), 2**63 - 1) for s in scores.tolist()], np.int64)
            top = np.lexsort((c_ids, ~scores))
        top = [i for i in top[: k + 1].tolist() if c_ids[i] != q][:k]
        out_q += [q] * len(top)
        out_c += c_ids[top].tolist()
        out_s += scores[top].tolist()
    return out_q, out_c, out_s


def best_of_tiles(q_ids: np.ndarray, queries: np.ndarray, c_ids: np.ndarray, candidates: np.ndarray, k: int, tile: int) -> list[np.ndarray]:
    """As ``best_of_block``, a tile of candidates after the other."""
    parts = [best_of_block(q_ids, queries, c_ids[at : at + tile], candidates[at : at + tile], k) for at in range(0, len(c_ids), tile)]
    q, c, s = (np.concatenate([np.array(p, np.int64) for p in column]) for column in zip(*parts))
    order = np.lexsort((c, ~s, q))
    q, c, s = q[order], c[order], s[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    return [column[place < k] for column in (q, c, s)]


def exact_top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: float = 64.0,
    numbers: int = NUMBERS,
    tile_numbers: int = TILE_NUMBERS,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest inner products.

    ``is_query`` is a condition on ``id_col``.  Ties go to the smaller id; a query with
    fewer than k other vectors gets all of them.  Missing components count as zero.  Of rows
    that repeat an id the smallest vector takes part; rows without an id do not.  An empty table gives no rows.
    ``numbers`` bounds a block and ``tile_numbers`` a tile by the numbers in them, at the width of
    the longest vector, so memory does not depend on the width; the result depends on neither.
    A component beyond 64 bits counts as the nearest 64-bit whole number, and so does a score,
    after its products are summed exactly.
    """
    rows = whole_vectors(vectors, id_col, vector_col, scale)
    rows = cut(rows.groupBy("vec_id").agg(F.min("v").alias("v")))
    asked = vectors.where(is_query).select(F.col(id_col).cast("long").alias("vec_id")).distinct()
    asked = rows.join(asked, "vec_id", "left_semi")
    count, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    block, tile = (max(1, n // max(1, width)) for n in (numbers, tile_numbers))
    queries, nq = _blocks(asked, asked.count(), block, "qb")
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    candidates, nc = _blocks(rows, count, block, "cb", 2 * cores, tile)
    pairs = queries.withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(nc - 1)))).join(
        candidates.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1)))), ["qb", "cb"]
    )

    def score(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                q, c = (batch.column(n)[i].values for n in ("qb_rows", "cb_rows"))
                q_ids, c_ids = q.field(0).to_numpy(), c.field(0).to_numpy()
                columns = best_of_tiles(q_ids, matrix(q.field(1)), c_ids, matrix(c.field(1)), k, tile)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["query_id", "vec_id", "score"])

    found = pairs.select("qb_rows", "cb_rows").mapInArrow(score, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast(T.IntegerType()).alias("rank"), "vec_id", "score")
