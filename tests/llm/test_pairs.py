"""SimHash, near duplicates, components, repeated passages and exact top-k against brute force."""

from __future__ import annotations

import random
import re
import tracemalloc
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import xxhash

from reagentql.llm import graph, neardup, queries, simhash, suffixes, topk
from tests.llm.conftest import ODD, SCHEMA


def roots(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def plain_fingerprint(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_golay_code_shares_keys():
    rng = np.random.default_rng(5)
    assert (simhash.error_table() >= 0).sum() == 2048 - 1771 + 6 * 1771
    prints = rng.integers(-(2**63), 2**63, 300)
    for _ in range(20):
        flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 3), replace=False)) for _ in prints], np.uint64)
        row, key = simhash.golay_keys(prints)
        row2, key2 = simhash.golay_keys((prints.view(np.uint64) ^ flips).view(np.int64))
        one, two = defaultdict(set), defaultdict(set)
        for r, k in zip(row, key):
            one[r].add(k)
        for r, k in zip(row2, key2):
            two[r].add(k)
        assert all(one[i] & two[i] for i in range(len(prints)))


def test_large_buckets_lose_no_link(spark):
    """Many fingerprints around one centre: more in a key than are compared in pairs."""
    rng = random.Random(1)
    prints = {0}
    for _ in range(300):
        prints.add(sum(1 << b for b in rng.sample(range(30, 64), rng.randint(1, 4))))
    rows = [(i, f - (1 << 64) if f >= 1 << 63 else f) for i, f in enumerate(sorted(prints))]
    got = roots([(r.a, r.b) for r in simhash.links_within_two(spark.createDataFrame(rows, "node long, fp long")).collect()])
    pairs = [(i, j) for i, f in rows for j, g in rows if i < j and ((f ^ g) & (1 << 64) - 1).bit_count() <= 2]
    assert got == roots(pairs)


def test_query_op7(spark, small):
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    prints = {d: plain_fingerprint(t, 3) for d, t in docs}
    same = roots([(a, b) for a, f in prints.items() for b, g in prints.items() if (f ^ g).bit_count() <= 2])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op7_simhash(spark, small).collect()}
    assert got == {d: (f"{f:016x}", same[d]) for d, f in prints.items()}


def test_simhash_of_odd_rows(spark, odd, empty):
    got = sorted((r.doc_id, r.fp, r.component_id) for r in simhash.simhash_components(odd).collect())
    zero = [1, 2, 3]
    want = [(d, plain_fingerprint(t or "", 3), 1 if d in zero else d) for d, t, *_ in ODD]
    assert [(d, f & (1 << 64) - 1, c) for d, f, c in got] == sorted(want)
    assert simhash.simhash_components(empty).collect() == []
    nobody = spark.createDataFrame([(None, "a b c"), (9, "a b c"), (None, "d e f")], "doc_id long, text string")
    assert sorted(str(r.component_id) for r in simhash.simhash_components(nobody).collect()) == ["9", "9", "None"]


def test_components(spark):
    rng = random.Random(2)
    for links in ([], [(i, i + 1) for i in range(30)] + [(50, 50), (7, 60)], [(rng.randrange(80), rng.randrange(80)) for _ in range(50)]):
        got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
        assert got == roots([x for x in links if x[0] != x[1]])


def _near(rng, words, share):
    return [rng.choice("qwertyuiop") * 5 if rng.random() < share else w for w in words]


def test_near_duplicates(spark, odd, empty):
    rng = random.Random(4)
    docs = []
    for base in range(40):
        words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(300)]
        docs += [(base * 10 + k, " ".join(_near(rng, words, 0.01 * (k > 0)))) for k in range(4)]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    sets = {d: set(simhash.shingle_hashes(t, 5)) for d, t in docs}
    want = roots([(a, a) for a in sets] + [(a, b) for a in sets for b in sets if a < b and a // 10 == b // 10 and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    assert all(got[d] >= d // 10 * 10 for d in got)  # never across groups
    linked = [d for d in want if want[d] != d]
    assert sum(got[d] != d for d in linked) >= 0.95 * len(linked)
    kept = sorted(r.doc_id for r in neardup.drop_near_duplicates(odd).collect())
    assert kept == [1, 4, 4, 5, 6, 7]
    assert neardup.drop_near_duplicates(empty).collect() == []


def _similarity(a, b):
    return len(a & b) / len(a | b)


def test_all_links_by_similarity_with_templates(spark, monkeypatch):
    """Pairs at 0.8 to 0.85, to 0.9 and above in groups that share a template: every one is found, and no other.

    ``CELL`` is small, so that shingles of many rows are compared in cells.
    """
    monkeypatch.setattr(neardup, "CELL", 16)
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    docs = []
    for own, changes in ((40, (2, 5, 6)), (60, (2, 5, 6)), (300, (2, 4, 6))):
        template = [word() for _ in range(300 - own)]
        for _ in range(130):
            words = template + [word() for _ in range(own)]
            other = list(words)
            for i in rng.sample(range(0, 300, 6), rng.choice(changes)):
                other[i] = word()
            docs += [(len(docs), " ".join(words)), (len(docs) + 1, " ".join(other))]
    rng.shuffle(docs)
    sets = {d: set(simhash.shingle_hashes(t, 5)) for d, t in docs}
    ids = sorted(sets)
    pairs, bands = [], {0.8: 0, 0.85: 0, 0.9: 0}
    for a in ids:
        for b in ids[a + 1 :]:
            if len(sets[a] & sets[b]) > 100 and (s := _similarity(sets[a], sets[b])) >= 0.8:
                pairs.append((a, b))
                bands[max(x for x in bands if x <= s)] += 1
    assert min(bands.values()) > 30
    want = roots(pairs)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {d: want.get(d, d) for d in ids}


def test_pieces_of_runs(monkeypatch):
    """Runs longer than a task holds are passed on whole; complete runs without a possible pair are not."""
    monkeypatch.setattr(neardup, "HELD", 8)
    key = [1] * 3 + [2] * 30 + [3] * 4 + [4] * 2 + [5] * 3
    n = len(key)
    table = pa.table({"key": key, "node": range(n), "comp": [7] * 39 + [1, 2, 3], "size": pa.array([10] * n, pa.int32()), "reach": pa.array([12] * n, pa.int32())})
    kept = [k for b in neardup._by_run(table.to_batches(max_chunksize=3), neardup.MEET, 1, neardup._meeting) for k in b["key"].to_pylist()]
    assert kept.count(2) == 30 and kept.count(5) == 3 and not kept.count(4)


def test_empty_and_odd_near_duplicates(spark, odd, empty):
    got = sorted((r.doc_id, r.component_id) for r in neardup.near_duplicates(odd).collect())
    assert got == sorted((d, 1 if d in (1, 2, 3) else d) for d, *_ in ODD)
    assert neardup.near_duplicates(empty).collect() == []
    rows = spark.createDataFrame([(None, "a b c", "en", "s", 1), (None, "a b c", "en", "s", 1), (5, "a b c", "en", "s", 1), (4, "A b c", "en", "s", 1)], SCHEMA)
    assert sorted(str(r.doc_id) for r in neardup.drop_near_duplicates(rows).collect()) == ["4", "None", "None"]


def test_leaders_across_partitions(spark):
    """One fingerprint group larger than any partition ends as one component."""
    rng = random.Random(6)
    rows = [(i, sum(1 << b for b in rng.sample(range(60), rng.randint(0, 3))), 0) for i in range(600)]
    found = neardup.candidates(spark.createDataFrame(rows, "node long, f1 long, f2 long").dropDuplicates(["f1"]))
    assert len(set(roots([(r.a, r.b) for r in found.collect()]).values())) == 1


def test_repeated_passages(spark, odd, empty):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(5))
    shared = [[word() for _ in range(n)] for n in (50, 60, 49, 300, 26)]
    docs = []
    for d in range(30):
        words = []
        for _ in range(rng.randint(1, 3)):
            words += [word() for _ in range(rng.randint(0, 60))] + (rng.choice(shared) if d % 3 else [])
        docs.append((d, " ".join(words)))
    texts = {d: t.split() for d, t in docs}
    runs = defaultdict(set)
    for d, w in texts.items():
        for i in range(len(w) - 49):
            runs[tuple(w[i : i + 50])].add(d)
    want = {(d, j) for d, w in texts.items() for i in range(len(w) - 49) if len(runs[tuple(w[i : i + 50])]) > 1 for j in range(i, i + 50)}
    got = suffixes.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    covered = {(r.doc_id, j) for r in got for j in range(r.start, r.end)}
    assert want and want <= covered
    assert {d for d, _ in covered} == {d for d, _ in want}
    assert suffixes.repeated_passages(odd).collect() == [] == suffixes.repeated_passages(empty).collect()


def _rows_of_one_key(rng, n):
    """Rows (key, run, doc, at) with long shared runs and many rows of one document in a row."""
    words = [rng.integers(1, 1 << 32, 23, dtype=np.uint64).astype(">u4") for _ in range(3)]
    out = []
    for i in range(n):
        run = words[rng.integers(3)].copy()
        cut = int(rng.integers(0, 24))
        run[cut : cut + 1] = rng.integers(1, 4)
        out.append((int(rng.integers(0, 3)) if rng.random() < 0.8 else 9, run[: int(rng.integers(15, 24))].tobytes(), int(rng.choice([1, 1, 1, 1, 2, 3])), i))
    return sorted(out)


def test_neighbours_over_borders(monkeypatch):
    """Any cuts into partitions, batches and flushes give what comparing all pairs gives."""
    monkeypatch.setattr(suffixes, "HELD", 5)
    rng = np.random.default_rng(3)

    def common(a, b):
        a, b = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
        n = min(len(a), len(b))
        return int(np.argmin(np.append(a[:n] == b[:n], False)))

    for _ in range(40):
        rows = _rows_of_one_key(rng, 40)
        want = {r[3]: max([common(r[1], x[1]) for x in rows if x[0] == r[0] and x[2] != r[2]], default=0) for r in rows}
        cuts = sorted(rng.integers(0, 41, rng.integers(0, 12)).tolist())
        found = []
        for part, (low, high) in enumerate(zip([0, *cuts], [*cuts, 40])):
            columns = list(zip(*rows[low:high])) or [()] * 4
            table = pa.table({"key": pa.array(columns[0], pa.int64()), "after": pa.array(columns[1], pa.binary()), "doc_id": pa.array(columns[2], pa.int64()), "at": pa.array(columns[3], pa.int32())})
            for batch in suffixes._compare(table.to_batches(max_chunksize=3), "after", part):
                found += batch.to_pylist()
        edges = sorted((r for r in found if r["edge"] is not None), key=lambda r: (r["part"], r["key"], r["edge"], r["doc_id"], r["at"]))
        ends = {p: (a, b) for p, a, b in suffixes.joined_edges(edges)}
        got = {r["at"]: max(r["ext"], min(ends[r["part"]][0], r["from_left"]), min(ends[r["part"]][1], r["from_right"])) for r in found if r["edge"] is None}
        assert got == want


def test_repeated_passages_by_partitions(spark):
    """One passage that a document repeats many times between its copies elsewhere, cut into 1, 4 and 50 partitions."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(5))
    passage = [word() for _ in range(60)]
    docs = [(d, " ".join(word() for _ in range(30)) + " " + " ".join(passage) + " " + word()) for d in (1, 50)]
    docs += [(7, " ".join(" ".join(passage[2:58]) + " " + word() for _ in range(40)))]
    docs += [(8, "alone " * 10), (None, " ".join(passage))]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    before, results = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (1, 4, 50):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            results.append(sorted(tuple(r) for r in suffixes.repeated_passages(table).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1] == results[2]
    assert {(1, 30, 90), (50, 30, 90)} <= {r[:3] for r in results[0]}
    assert sum(r[0] == 7 and r[3] == 56 for r in results[0]) == 40


def test_repeated_ids_with_different_texts(spark):
    rng = random.Random(6)
    words = lambda n: " ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(n))
    shared = words(80)
    rows = [(1, shared), (1, words(300)), (2, words(20) + " " + shared), (2, words(20) + " " + shared)]
    got = sorted(tuple(r) for r in suffixes.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 0, 80, 80, 1), (2, 20, 100, 80, 1)]


def test_query_op5_equals_sql(spark, small):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{small}/embeddings.parquet'")
    want = sorted(con.execute(f"select query_id, rank, vec_id, score from ({queries.OP5_SQL})").fetchall())
    assert sorted(tuple(r) for r in queries.op5_exact_topk(spark, small).collect()) == want


def test_top_k_of_odd_rows(spark):
    from pyspark.sql import functions as F

    rows = [(0, [1.0, 0.5]), (20, [1.0, 0.5]), (3, [1.0]), (4, None), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [float("inf")]), (8, []), (9, [1e9, 1e9]), (9, [1e9, 1e9]), (None, [1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = sorted(tuple(r) for r in topk.exact_top_k(table, F.col("vec_id") % 20 == 0, 3, numbers=4, tile_numbers=2).collect())
    v = {i: [int(np.floor(64 * x)) for x in xs] for i, xs in rows if i in (0, 20, 3, 8, 9)}
    want = []
    for q in (0, 20):
        scores = sorted((-sum(a * b for a, b in zip(v[q], v[c])), c) for c in v if c != q)[:3]
        want += [(q, n + 1, c, -s) for n, (s, c) in enumerate(scores)]
    assert got == want
    big = [(0, [2.0**40 / 64, -(2.0**40)]), (1, [2.0**30 / 64, 0.0]), (6, [1.0, 0.0]), (2, [2.0**34 / 64, 0.0]), (3, [2.0**50, 2.0**50]), (4, [1e30, 0.0]), (5, [1e30, 0.0])]
    rows = topk.exact_top_k(spark.createDataFrame(big, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, 9).collect()
    most = 2**63 - 1
    assert [tuple(r) for r in sorted(rows, key=lambda r: r.rank)] == [(0, 1, 1, most), (0, 2, 2, most), (0, 3, 4, most), (0, 4, 5, most), (0, 5, 6, 2**46), (0, 6, 3, -(2**63))]
    assert topk.exact_top_k(table.limit(0), F.col("vec_id") % 20 == 0).collect() == []


def test_tiles_of_a_block():
    rng = np.random.default_rng(5)
    vectors = rng.integers(-3, 4, (90, 6))
    ids = np.arange(90) * 3
    for k, tile in ((1, 7), (4, 90), (4, 13), (200, 8)):
        got = list(zip(*(c.tolist() for c in topk.best_of_tiles(ids[::9], vectors[::9], ids, vectors, k, tile))))
        want = []
        for q, v in zip(ids[::9].tolist(), vectors[::9]):
            scores = sorted((-int(np.dot(v, w)), c) for c, w in zip(ids.tolist(), vectors) if c != q)[:k]
            want += [(q, c, -s) for s, c in scores]
        assert got == want


def test_wide_vectors_are_dealt_by_numbers(spark, monkeypatch):
    """At 1,024 numbers a block holds a 16th as many vectors; results are those of plain products."""
    rng = np.random.default_rng(7)
    v = rng.integers(-40, 41, (3000, 1024))
    rows = [(i, [float(x) for x in v[i]]) for i in range(300)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.exact_top_k(table, "vec_id % 20 = 0", 5, scale=1.0, numbers=1 << 16, tile_numbers=1 << 14)
    full = v[:300] @ v[:300].T
    want = []
    for q in range(0, 300, 20):
        best = sorted((-int(full[q, c]), c) for c in range(300) if c != q)[:5]
        want += [(q, n + 1, c, -s) for n, (s, c) in enumerate(best)]
    assert sorted(tuple(r) for r in got.collect()) == want
    sizes = []
    plain = topk._blocks
    monkeypatch.setattr(topk, "_blocks", lambda rows, count, size, *more: (sizes.append(size), plain(rows, count, size, *more))[1])
    topk.exact_top_k(table, "vec_id % 20 = 0", 5, scale=1.0)
    assert sizes == [1024, 1024]  # 8 MB a block at 8 bytes
    tracemalloc.start()
    topk.best_of_tiles(np.arange(1024), v[:1024], np.arange(1024), v[:1024], 20, 256)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6


def test_one_id_with_different_texts(spark):
    """Every row gets the group of its own text, named by the smallest id that has one of the group's texts."""
    rng = random.Random(3)
    one, two = (" ".join("".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(40)) for _ in range(2))
    rows = [(5, one), (5, two), (3, one), (9, two + " more"), (None, one), (7, "something else altogether in few words")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    got = neardup.near_duplicates(docs).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(3, 3), (5, 3), (5, 5), (7, 7), (9, 5)]


def test_matrix_of_lists():
    lists = pa.array([[9], [1, 2, 3], [], [4], [5, 6]], pa.list_(pa.int64()))
    assert topk.matrix(lists[1:]).tolist() == [[1, 2, 3], [0, 0, 0], [4, 0, 0], [5, 6, 0]]
    assert topk.matrix(lists[:0]).shape[0] == 0 and topk.matrix(pa.array([[1, 2], [3, 4]], pa.list_(pa.int64()))).tolist() == [[1, 2], [3, 4]]


def test_near_copies_among_look_alikes(spark):
    """Pairs at about 0.85 inside a templated group at 0.6 to 0.7 are all found."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(9))

    def changed(words, n):
        words = list(words)
        for i in rng.sample(range(0, len(words), 5), n):
            words[i] = word()
        return words

    template = [word() for _ in range(300)]
    texts = [changed(template, 6) for _ in range(2000)]
    texts += [changed(w, 4) for w in texts[:100]]
    docs = [(i, " ".join(w)) for i, w in enumerate(texts)]
    sets = [set(simhash.shingle_hashes(t, 5)) for _, t in docs]
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    pairs = [(a, b) for b in range(len(sets)) for a in (*range(0, min(b, 100)), b - 2000) if 0 <= a < b and alike(a, b)]
    assert {(i, 2000 + i) for i in range(100)} <= set(pairs)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(got[a] == got[b] for a, b in pairs)


def test_large_look_alikes_are_told_apart_before_their_sets_are_fetched(spark, monkeypatch):
    """Of large texts with a passage in common only those that are near copies get verified, and none of these is left out."""
    rng = random.Random(12)
    words = lambda n: [f"w{rng.randrange(1_000_000)}" for _ in range(n)]
    shared = words(60)
    texts = [words(3000) + shared for _ in range(24)]
    for i in range(4):
        copy = list(texts[i])
        for at in rng.sample(range(0, 3000, 5), 40 + 10 * i):
            copy[at] = "other"
        texts.append(copy + words(700 if i == 3 else 0))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    sets = [set(simhash.shingle_hashes(" ".join(t), 5)) for t in texts]
    pairs = [(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert (0, 24) in pairs
    monkeypatch.setattr(neardup, "common_shingles", lambda rows: (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    seen, plain = [], neardup.verified
    monkeypatch.setattr(neardup, "verified", lambda links, rows: seen.append(links.count()) or plain(links, rows))
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()}
    assert {k: v for k, v in got.items() if k != v} == {k: v for k, v in roots(pairs).items() if k != v}
    assert sum(seen) <= len(pairs) + 4


def test_fewer_odd_buckets_by_folding():
    h = np.unique(np.random.default_rng(3).integers(0, 1 << 63, 5000).astype(np.uint64))
    wide = neardup.odd_buckets(h)
    narrow = np.packbits(np.bincount((neardup.mixed(h) % np.uint64(1024)).astype(np.int64), minlength=1024) & 1).tobytes()
    assert len(wide) == 1024 and neardup.folded(wide, 128).tobytes() == narrow
    assert len(neardup.odd_buckets(h[:0])) == len(neardup.odd_buckets(h[:1024])) == 128
