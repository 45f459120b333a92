from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from reagentql.llm import quality
from reagentql.llm.common import table
from reagentql.llm.quality import TOKEN, WIDTH, WINDOW, context_table, drop_poor, fit, score_documents


def test_contexts_equal_a_plain_count(spark, monkeypatch):
    texts = ["The cat sat, the cat sat on 12 mats!!", None, "", "a", "word word word other", "x y " * 70]
    plus, minus = quality.index_vectors()
    cache = quality.word_buckets()
    want, seen = {}, {}
    for t in texts:
        b = [cache[w] for w in TOKEN.findall(t or "")]
        b = [quality.REPEAT if i and b[i - 1] == x else x for i, x in enumerate(b)]
        for i, x in enumerate(b):
            seen[x] = seen.get(x, 0) + 1
            v = want.setdefault(x, np.zeros(WIDTH, int))
            for j in range(max(0, i - WINDOW), min(len(b), i + WINDOW + 1)):
                if j != i:
                    v[plus[b[j]]] += 1
                    v[minus[b[j]]] -= 1
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for piece, parts in ((200_000, 3), (8, 1), (1, 2)):
        found = quality.Neighbours
        # Pieces of any length give the same sums.
        got = {}
        monkeypatch.setattr(quality, "PIECE", piece)
        n = found()
        for t in texts:
            for p in quality.bucket_pieces(t or "", cache):
                n.put(p)
            n.end_text()
        n.count()
        got = {int(i): n.sums.reshape(-1, WIDTH)[i].tolist() for i in np.flatnonzero(n.seen)}
        assert got == {k: v.tolist() for k, v in want.items()}
        assert {int(i): int(n.seen[i]) for i in np.flatnonzero(n.seen)} == seen
        rows = context_table(df.repartition(parts)).collect()
        assert {r["bucket"]: [r[f"c{i}"] for i in range(WIDTH)] for r in rows} == got


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = fit(docs, labels)
    rows = score_documents(docs, model).join(labels, "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    poor, good = [r["score"] for r in held if not r["quality"]], [r["score"] for r in held if r["quality"]]
    assert len(poor) > 5 and np.mean(np.array(poor) < 0.3) >= 0.9 and np.mean(np.array(good) >= 0.3) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_held_out_labels_and_partitions_do_not_matter(spark, small):
    docs, labels = table(spark, small, "documents"), table(spark, small, "labels")
    other = labels.withColumn("quality", F.when(quality.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = fit(docs, labels), fit(docs.repartition(7), other)
    assert a.temperature == b.temperature and all(np.allclose(x, y) for x, y in zip(a.weights, b.weights)) and np.array_equal(a.vectors, b.vectors)


def test_temperature():
    draw = np.random.default_rng(0)
    logits = draw.normal(0, 2, 20_000)
    y = (draw.random(20_000) < 1 / (1 + np.exp(-logits))).astype(float)
    assert quality.best_temperature(logits * 4, y) == pytest.approx(4, rel=0.1)


def test_odd_empty_and_unlabelled(spark, odd, empty):
    labels = spark.createDataFrame([(1, 0), (4, 1), (6, 1), (7, 0), (None, 1), (9, None), (3, 1), (2, 0)], "doc_id long, quality int")
    model = fit(odd, labels)
    scores = {(r["doc_id"], r["score"]) for r in score_documents(odd, model).collect()}
    assert len(scores) == 7 and len({s for i, s in scores if i in (1, 2, 3)}) == 1
    assert score_documents(empty, model).count() == 0 and drop_poor(empty, model).count() == 0
    kept = drop_poor(odd, model)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {i for i, s in scores if s >= 0.3}
    for lab, score in ((labels.limit(0), 0.5), (labels.where("quality = 1"), 1.0)):
        assert {r["score"] for r in score_documents(odd, fit(odd, lab)).collect()} == {score}
    assert {r["score"] for r in score_documents(odd, fit(empty, labels)).collect()} == {0.5}
