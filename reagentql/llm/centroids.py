"""Exact k-means over whole-number vectors with block-norm screening.

A vector is compressed to a code of one byte a number, and the norms of its segments of what the
code leaves over.  By Cauchy and Schwarz the rest adds to the product with a centroid at most the
sum of the segments' norms times those of the centroid's segments.  So code and norms give a lower
bound of the squared distance.  A vector gets the exact distance of the centroid with the least
bound, then of those whose bounds do not exceed what is known; the others are never computed.
Distances are sums of whole numbers, so assignment, ties and centroids are exact.

A round reads the stored vectors once and sends k rows of sums from each task; the driver holds
only the centroids.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reagentql.llm.common import Scratch

#: Segments whose norms stand for what the codes leave over.
SEGMENTS = 8
#: Numbers below this in size have distances below 2^63 in up to 64 dimensions; others are computed with Python's whole numbers.
NARROW = 1 << 27
#: What rounding may take off a bound: a share of the product of norms, and of the squares.
SLACK, FINE = 1e-6, 1e-9
LOW, HIGH = -(2**63), 2**63 - 1


def whole_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 1024.0, dims: int = 64) -> DataFrame:
    """vec_id, v: floor(scale * x) of every component; only vectors of ``dims`` finite components.

    A component beyond 64 bits counts as the nearest 64-bit whole number.
    """
    x = F.transform(F.col(vector_col), lambda e: e.cast("double"))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))
    good = (F.size("x") == dims) & F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return rows.where(F.coalesce(good, F.lit(False))).select("vec_id", F.transform("x", lambda e: F.floor(e * scale).cast("long")).alias("v"))


def segment_norms(v: np.ndarray) -> np.ndarray:
    """Norms of the segments of each row."""
    return np.stack([np.sqrt(np.square(part.astype(np.float64)).sum(1)) for part in np.array_split(v, SEGMENTS, axis=1)], 1).astype(np.float32)


@dataclass
class Compressed:
    """Vectors as codes of ``step`` each, the norms of what is left over by segments, and their squared norms."""

    step: np.ndarray
    code: np.ndarray
    rest: np.ndarray
    square: np.ndarray

    def __getitem__(self, rows) -> Compressed:
        return Compressed(self.step[rows], self.code[rows], self.rest[rows], self.square[rows])


def compressed(v: np.ndarray) -> Compressed:
    """Whole-number vectors in compressed form."""
    largest = np.maximum(v.max(1, initial=0), ~v.min(1, initial=-1))
    step = largest // 127 + 1
    code = ((v + (step // 2)[:, None]) // step[:, None]).astype(np.int8)
    return Compressed(step, code, segment_norms(v - code * step[:, None]), np.square(v.astype(np.float64)).sum(1))


def lower_bounds(x: Compressed, centres: np.ndarray) -> np.ndarray:
    """Lower bounds of the squared distances of each vector from each centroid, rounding allowed for."""
    c = centres.astype(np.float64)
    product = (x.code.astype(np.float64) @ c.T) * x.step.astype(np.float64)[:, None]
    rest = (x.rest.astype(np.float64) @ segment_norms(centres).astype(np.float64).T) * (1 + SLACK)
    squares = x.square[:, None] + np.square(c).sum(1)[None, :]
    return squares * (1 - FINE) - 2 * product - 2 * rest


def nearest(v: np.ndarray, x: Compressed, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray, int]:
    """Of each row the nearest centroid (of equals the first) and its squared distance, held at 64 bits; and how many distances were computed."""
    cluster, distance = np.zeros(len(v), np.int32), np.zeros(len(v), np.int64)
    wide = ((v >= NARROW) | (v <= -NARROW)).any(1)
    if v.shape[1] > 64 or any(abs(x) >= NARROW for c in centroids for x in c):
        wide[:] = True
    for i in np.flatnonzero(wide).tolist():
        row = v[i].tolist()
        far = [sum((x - y) ** 2 for x, y in zip(row, c)) for c in centroids]
        cluster[i] = far.index(min(far))
        distance[i] = min(min(far), HIGH)
    done = int(wide.sum()) * len(centroids)
    if wide.all():
        return cluster, distance, done
    rows, centres = v[~wide], np.array(centroids, np.int64)
    bounds = lower_bounds(x[~wide], centres)
    chosen = bounds.argmin(1).astype(np.int32)
    best = np.square(rows - centres[chosen]).sum(1)
    started = chosen.copy()
    done += len(rows)
    for j in range(len(centres)):
        left = np.flatnonzero((started != j) & (bounds[:, j] <= best))
        found = np.square(rows[left] - centres[j]).sum(1)
        better = (found < best[left]) | ((found == best[left]) & (j < chosen[left]))
        best[left[better]], chosen[left[better]] = found[better], j
        done += len(left)
    cluster[~wide], distance[~wide] = chosen, best
    return cluster, distance, done


STORED = "vec_id long, v array<long>, step long, code array<tinyint>, rest array<float>, square double"


def _stored(batch: pa.RecordBatch, dims: int) -> tuple[np.ndarray, Compressed]:
    """The vectors of a stored batch and their compressed form."""
    at = batch.schema.names.index
    step, square = (batch.column(at(n)).to_numpy(zero_copy_only=False) for n in ("step", "square"))
    code, rest = _matrix(batch.column(at("code")), dims, np.int8), _matrix(batch.column(at("rest")), SEGMENTS, np.float32)
    return _matrix(batch.column(at("v")), dims, np.int64), Compressed(step, code, rest, square)


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def _matrix(column: pa.Array, dims: int, kind: type) -> np.ndarray:
    """A column of equally long lists, without Python lists between."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, dims)


def _sums(vectors: DataFrame, centroids: list[list[int]], dims: int) -> list[list[int]]:
    """The centroids after one round: floors of the means of their vectors; those without vectors stay."""

    def run(batches):
        counts = [0] * len(centroids)
        sums = [[0] * dims for _ in centroids]
        for batch in batches:
            v, x = _stored(batch, dims)
            cluster, _, _ = nearest(v, x, centroids)
            for j in np.unique(cluster).tolist():
                rows = v[cluster == j]
                # High and low halves are summed apart, so that no sum passes 63 bits.
                high, low = (rows >> 32).sum(0).tolist(), (rows & 0xFFFFFFFF).sum(0).tolist()
                counts[j] += len(rows)
                sums[j] = [s + (h << 32) + w for s, h, w in zip(sums[j], high, low)]
        used = [j for j, n in enumerate(counts) if n]
        columns = [pa.array(used, pa.int32()), pa.array([counts[j] for j in used], pa.int64()), pa.array([[Decimal(x) for x in sums[j]] for j in used], pa.list_(pa.decimal128(38, 0)))]
        yield pa.RecordBatch.from_arrays(columns, ["cluster", "n", "sums"])

    parts = vectors.drop("vec_id").mapInArrow(run, "cluster int, n long, sums array<decimal(38,0)>")
    totals = parts.select("cluster", "n", F.posexplode("sums").alias("at", "part")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("part").alias("total"))
    out = [list(c) for c in centroids]
    for r in totals.collect():  # k * dims rows
        out[r["cluster"]][r["at"]] = int(r["total"]) // r["n"]
    return out


def first_centroids(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors with the smallest sha256 of seed and id; rows without an id come last, equal hashes go by the vector."""
    order = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("vec_id").cast("string")).cast("binary"), 256)
    ranked = vectors.select("v", F.when(F.col("vec_id").isNotNull(), order).alias("h"))
    return [list(r["v"]) for r in ranked.orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()]


def centroid_clusters(
    df: DataFrame,
    k: int = 8,
    rounds: int = 10,
    seed: int = 3,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: float = 1024.0,
    dims: int = 64,
) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid (its numbers) for every kept vector.

    Vectors that are null, of another length, or with null or non-finite components take no part.
    Repeated ids and rows without an id are vectors of their own.  Fewer than k vectors give fewer
    centroids, an empty table no rows.  Of equally near centroids the one with the smaller number
    is taken.  Distances and their sums are held at 64 bits; sums behind the centroids are exact.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)

    def compress(batches):
        for batch in batches:
            x = compressed(_matrix(batch.column(1), dims, np.int64))
            columns = [batch.column(0), batch.column(1), pa.array(x.step), _lists(x.code), _lists(x.rest), pa.array(x.square)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "v", "step", "code", "rest", "square"])

    rows = whole_vectors(df, id_col, vector_col, scale, dims)
    vectors = scratch.spill(rows.mapInArrow(compress, STORED))
    centroids = first_centroids(vectors, k, seed)
    for _ in range(rounds if centroids else 0):
        after = _sums(vectors, centroids, dims)
        if after == centroids:
            break  # nothing changes any more
        centroids = after

    def assign(batches):
        for batch in batches:
            cluster, distance, _ = nearest(*_stored(batch, dims), centroids)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster), pa.array(distance)], ["vec_id", "cluster", "distance"])

    schema = "vec_id long, cluster int, distance long"
    assigned = scratch.last(vectors.mapInArrow(assign, schema) if centroids else spark.createDataFrame([], schema))
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # k rows
    every = min(sum(int(r["s"]) for r in sums), HIGH)
    known = [(r["cluster"], min(int(r["s"]), HIGH), every, centroids[r["cluster"]]) for r in sums]
    info = spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return assigned.join(F.broadcast(info), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")
