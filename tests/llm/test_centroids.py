from __future__ import annotations

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from reagentql.llm import contract_sql, queries
from reagentql.llm.centroids import centroid_clusters, compressed, lower_bounds, nearest

SCHEMA = "vec_id long, embedding array<float>, cluster int, distance long"


def brute_force(rows, k, rounds):
    kept = []
    for vec_id, x in rows:
        if x is not None and len(x) == 64 and all(e is not None and math.isfinite(e) for e in x):
            kept.append((vec_id, [math.floor(1024 * float(np.float32(e))) for e in x]))
    h = lambda i: (1, "") if i is None else (0, hashlib.sha256(f"3:{i}".encode()).hexdigest())
    centres = [v for _, v in sorted(kept, key=lambda r: (h(r[0]), r[1]))[:k]]

    def assign():
        out = []
        for _, v in kept:
            far = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centres]
            out.append((far.index(min(far)), min(far)))
        return out

    for _ in range(rounds):
        parts = [[] for _ in centres]
        for (j, _), (_, v) in zip(assign(), kept):
            parts[j].append(v)
        centres = [[sum(x) // len(p) for x in zip(*p)] if p else c for p, c in zip(parts, centres)]
    last = assign()
    every = sum(d for _, d in last)
    return sorted((str(i), j, d, sum(e for m, e in last if m == j), every, centres[j]) for (i, _), (j, d) in zip(kept, last))


def vectors(n, seed=0, spread=1.0):
    draw = random.Random(seed)
    centres = [[draw.gauss(0, spread) for _ in range(64)] for _ in range(12)]
    rows = [(i // 2, [float(np.float32(c + draw.gauss(0, 0.4))) for c in draw.choice(centres)]) for i in range(n)]
    return rows + [(None, rows[0][1]), (7, rows[-1][1])] if rows else rows


ODD = [(1, None), (2, []), (3, [1.0] * 63), (4, [1.0] * 63 + [None]), (5, [float("nan")] * 64), (6, [float("inf")] * 64), (8, [0.0] * 64)]


@pytest.mark.parametrize("n,spread", [(0, 1), (3, 1), (300, 1.0), (200, 0.0)])
def test_equals_brute_force(spark, n, spread):
    rows = vectors(n, n, spread) + (ODD if n else ODD[:6])
    df = spark.createDataFrame([(i, x, 0, 0) for i, x in rows], SCHEMA).repartition(3)
    got = centroid_clusters(df).collect()
    found = sorted((str(r["vec_id"]), r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], list(r["centroid"])) for r in got)
    assert found == brute_force(rows, 8, 10)


def test_query_equals_sql(spark, tmp_path):
    rows = [(i, x) for i, x in vectors(250, 5) + ODD if i is not None]
    spark.createDataFrame([(i, x, 0, 0) for i, x in rows], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    cursor = con.execute(contract_sql.centroids_sql())
    names = [d[0] for d in cursor.description]
    assert sorted(tuple(r[c] for c in names) for r in queries.op12_centroids(spark, str(tmp_path)).collect()) == sorted(cursor.fetchall())


def test_bounds_never_exceed_distances_and_spare_most():
    draw = np.random.default_rng(3)
    for size in (1, 50, 5_000, 10_000_000):
        centres = draw.integers(-size, size + 1, (8, 64)) * np.geomspace(0.01, 1, 8)[:, None].round(2)
        centres = centres.astype(np.int64)
        v = centres[draw.integers(0, 8, 2000)] + draw.integers(-max(size // 20, 1), max(size // 20, 1) + 1, (2000, 64))
        exact = np.square(v[:, None, :] - centres[None]).sum(2)
        assert (lower_bounds(compressed(v), centres) <= exact).all()
        cluster, distance, done = nearest(v, compressed(v), centres.tolist())
        assert (cluster == exact.argmin(1)).all() and (distance == exact.min(1)).all()
        if size >= 50:
            assert done < 0.3 * 8 * len(v)


def test_bounds_spare_most_of_vectors_of_equal_norm():
    """Directions at random, as embeddings are: norms alone tell nothing, codes do."""
    draw = np.random.default_rng(6)
    v = draw.normal(size=(4000, 64))
    v = np.floor(1024 * v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.int64)
    for centres in (v[:8], np.stack([v[i::8].sum(0) // 500 for i in range(8)])):
        exact = np.square(v[:, None, :] - centres[None]).sum(2)
        cluster, distance, done = nearest(v, compressed(v), centres.tolist())
        assert (cluster == exact.argmin(1)).all() and (distance == exact.min(1)).all() and done < 0.3 * 8 * len(v)


def test_wide_numbers_are_exact():
    v = np.array([[2**62] * 64, [-(2**63)] * 64, [5] * 64, [2**27] + [0] * 63], np.int64)
    cluster, distance, _ = nearest(v, compressed(v), [[2**62 - 1] * 64, [-(2**63)] * 64, [4] * 64])
    assert cluster.tolist() == [0, 1, 2, 2] and distance.tolist() == [64, 0, 64, (2**27 - 4) ** 2 + 63 * 16]


def test_components_beyond_64_bits_count_as_the_nearest(spark):
    rows = [(i, [3e38 if i % 2 else -3e38] + [float(i)] * 63) for i in range(10)]
    got = centroid_clusters(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert len(got) == 10 and all(0 <= r["distance"] < 2**63 for r in got)
