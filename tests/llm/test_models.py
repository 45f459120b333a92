"""Toxicity, decontamination and the whole pipeline."""

from __future__ import annotations

import itertools
import random
import zlib

import pyarrow as pa
import pytest

from reagentql.llm import decontaminate, queries, toxicity


def plain_segments(positive, n):
    """Ruzzo and Tompa's segments by recursion on the best one."""
    scores = [-toxicity.DRIFT] * n
    for i, s in positive:
        scores[i] += s

    def best(low, high):
        top = None
        for a in range(low, high):
            total = 0.0
            for b in range(a, high):
                total += scores[b]
                if total > 1e-9 and (top is None or total > top[0] + 1e-9):
                    top = total, a, b
        if top is None:
            return []
        return [*best(low, top[1]), (top[1], top[2], top[0]), *best(top[2] + 1, high)]

    return best(0, n)


def test_segments():
    rng = random.Random(3)
    for _ in range(60):
        n = rng.randint(1, 30)
        positive = [(i, rng.choice((0.3, 0.7, 2.0)) + rng.random()) for i in sorted(rng.sample(range(n), rng.randint(0, min(n, 6))))]
        got = toxicity.segments(positive)
        want = plain_segments(positive, n)
        assert [x[:2] for x in got] == [x[:2] for x in want]
        assert [x[2] for x in got] == pytest.approx([x[2] for x in want])


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op2_toxicity(spark, sf).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(p == t for p, t in held) >= 0.9 * len(held)


def test_toxicity_without_labels(spark, odd, empty):
    none = spark.createDataFrame([(1, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(odd, none)
    assert not model.lexicon and {r.score < 0.3 for r in toxicity.score_documents(odd, model).collect()} == {True}
    kept = toxicity.drop_toxic(odd, model)
    assert kept.schema == odd.schema and kept.count() == odd.count()
    assert toxicity.score_documents(empty, model).collect() == []


def _words(rng, n):
    return ["".join(rng.choice("abcdefghijk") for _ in range(6)) for _ in range(n)]


def test_recall_and_precision_of_toxicity(spark):
    """Held-out labelled rows: most toxic ones are found and few others are."""
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [(labels[r.doc_id], r.predicted) for r in queries.op2_toxicity(spark, sf).collect() if r.held_out and labels.get(r.doc_id) is not None]
    found = sum(a == b == 1 for a, b in rows)
    assert found >= 0.9 * sum(a for a, _ in rows) and found >= 0.9 * sum(b for _, b in rows)


def test_drop_toxic_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1), (7, 0), (None, 1), (1, None)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels)
    kept = toxicity.drop_toxic(odd.union(odd), model)
    assert kept.columns == odd.columns and kept.count() == 16
    assert toxicity.drop_toxic(empty, model).collect() == [] == toxicity.drop_toxic(empty, toxicity.fit(empty, labels.limit(0))).collect()


def test_decontamination_tolerates_substitutions(spark, odd, empty):
    rng = random.Random(9)
    items = [(i, " ".join(_words(rng, 40))) for i in range(20)] + [(100, "short item of six words here"), (101, None), (102, "")]
    docs, want = [], set()
    for d in range(60):
        words = _words(rng, 100)
        if d % 3 == 0:
            item = items[d % 20][1].split()
            for k in rng.sample(range(40), 4):
                item[k] = "changed"
            words[30:30] = item
            want.add((d, d % 20))
        if d == 1:
            words += items[20][1].upper().split()
            want.add((1, 100))
        docs.append((d, ", ".join(words)))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.benchmark_overlaps(table, bench).collect()}
    assert got == want
    # In blocks of a few items the result is the same.
    assert {(r.doc_id, r.item_id) for r in decontaminate.benchmark_overlaps(table, bench, block_chars=1000).collect()} == want
    kept = {r.doc_id for r in decontaminate.drop_contaminated(table, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}
    assert decontaminate.benchmark_overlaps(odd, bench).collect() == [] == decontaminate.benchmark_overlaps(empty, bench).collect()
    assert decontaminate.benchmark_overlaps(table, bench.limit(0)).collect() == []


def plain_overlaps(doc, item):
    """Every alignment tried, seeds or none: the rows of those that match."""
    out = []
    for shift in range(-len(item) + 1, len(doc)):
        low, high = max(0, -shift), min(len(item), len(doc) - shift)
        same = [doc[i + shift] == item[i] for i in range(low, high)]
        if len(item) < 11:
            if sum(same) >= len(item) - (len(item) > 3):
                start, end = same.index(True), len(same) - same[::-1].index(True)
                out.append((-sum(same), low + shift + start, low + start, low + shift + end))
            continue
        best, upto = None, [0, *itertools.accumulate(same)]
        for end in range(1, len(same) + 1):
            for start in range(end):
                matches = upto[end] - upto[start]
                gain = 2 * matches - (end - start)
                if best is None or gain > best[0]:
                    best = gain, start, end, matches
        _, start, end, matches = best
        need = min(12, -(-3 * len(item) // 4))
        if matches >= need and matches >= 0.75 * (end - start):
            out.append((-matches, low + shift + start, low + start, low + shift + end))
    return out


def token_table(items):
    hashes = lambda ws: decontaminate.token_hashes(" ".join(ws))
    return decontaminate.SeedTable([(k, hashes(ws)) for k, ws in items]), hashes


def test_overlaps_equal_brute_force(monkeypatch):
    """All alignments of all items, with few different words, so that seeds and periods abound; none that matches is missed."""
    rng = random.Random(2)
    seen = 0
    for small in (False, True):
        if small:
            monkeypatch.setattr(decontaminate, "HITS", 3)
            monkeypatch.setattr(decontaminate, "ALIGNED", 40)
        for _ in range(25):
            words = [f"w{i}" for i in range(rng.choice((2, 4, 12)))]
            items = [(k, [rng.choice(words) for _ in range(rng.choice((1, 2, 3, 4, 5, 6, 7, 8, 10, 11, 12, 16, 25)))]) for k in range(6)]
            doc = [rng.choice(words) for _ in range(30)]
            for k in (1, 3, 5):
                doc += [w if rng.random() < 0.85 else "other" for w in items[k][1]]
            table, hashes = token_table(items)
            want = {k: min(found) for k, ws in items if (found := plain_overlaps(doc, ws))}
            got = {k: (-m, a, t, b) for k, a, b, t, m, _ in table.find(hashes(doc))}
            assert got == want and table.any(hashes(doc)) == bool(want)
            seen += len(want)
    assert seen > 150


def test_no_substituted_item_is_missed():
    """Items of every length from 1 to 40, with as many tokens changed as the rule allows and one more, anywhere."""
    rng = random.Random(8)
    found = 0
    for n in (*range(1, 18), 20, 24, 31, 40):
        for changed in range(0, n // 4 + 3):
            for k in range(4):
                item = _words(rng, n)
                table, hashes = token_table([(k, item)])
                placed = list(item)
                for i in rng.sample(range(n), min(changed, n)):
                    placed[i] = "other"
                doc = _words(rng, 2) + placed + _words(rng, 1)
                rows = plain_overlaps(doc, item)
                assert [(-m, a, t, b) for _, a, b, t, m, _ in table.find(hashes(doc))] == sorted(rows)[:1]
                found += bool(rows)
    assert found > 250


def test_masks_hit_every_stretch():
    """No string of equal and other tokens, with nine equal or more and three quarters of it equal, is free of the masks.

    Strings are extended token by token.  Of those with the same last tokens only the one with the
    most equal tokens beyond three for each other one matters.
    """
    span = max(map(len, decontaminate.MASKS))
    bits = [(len(m), int(m, 2)) for m in decontaminate.MASKS]
    states = {(0, 0, 0): 0}  # how many last tokens, the tokens, equal ones up to nine: balance
    for _ in range(60):
        after = {}
        for (n, last, equal), balance in states.items():
            for bit in (0, 1):
                size, tokens = n + 1, last << 1 | bit
                if any(size >= k and tokens & m == m for k, m in bits):
                    continue
                key = min(size, span - 1), tokens & (1 << min(size, span - 1)) - 1, min(9, equal + bit)
                after[key] = max(after.get(key, -999), balance + (1 if bit else -3))
        states = after
        assert all(balance < 0 for (_, _, equal), balance in states.items() if equal == 9)
    assert max(states.values()) < -5  # the longer a free string, the farther it is from three quarters


def test_hot_seeds():
    """Thousands of items that begin alike, against a text made of that beginning."""
    rng = random.Random(4)
    start = _words(rng, 20)
    items = [(k, decontaminate.token_hashes(" ".join(start + _words(rng, 10)))) for k in range(2400)]
    table = decontaminate.SeedTable(items)
    found = table.find(decontaminate.token_hashes(" ".join(start * 50)))
    assert len(found) == 2400 and all(r[1:5] == (0, 20, 0, 20) or r[4] > 20 for r in found)


def test_drop_contaminated_of_odd_rows(spark, odd, empty):
    bench = spark.createDataFrame([(1, "word " * 12), (1, "word " * 12), (None, "plain words and a few more of them"), (2, None)], "item_id long, text string")
    for chars in (16_000_000, 40):
        kept = decontaminate.drop_contaminated(odd, bench, block_chars=chars)
        assert kept.columns == odd.columns
        assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 4, 5, 6]
        assert decontaminate.drop_contaminated(empty, bench, block_chars=chars).collect() == []
    assert decontaminate.drop_contaminated(odd, bench.limit(0)).count() == 8
    twice = decontaminate.benchmark_overlaps(odd.union(odd), bench, block_chars=40).collect()
    assert [(r.doc_id, r.item_id, r.start, r.end) for r in twice] == [(7, 1, 0, 12)] * 2


def test_pipeline_against_brute_force(spark, tmp_path):
    """Every stage takes effect, and what is clean comes through with the library's ids."""
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(12)
    docs, labels = [], []
    for d in range(400):
        words = _words(rng, 120)
        if d % 8 == 3:
            for k in (10, 11, 40):
                words[k] = rng.choice(("insulta", "insultb"))
        docs.append([d, " ".join(words)])
        labels.append((d, 1, int(d % 8 == 3)))
    bench = [(1, " ".join(_words(rng, 40)))]
    docs[40][1] = docs[16][1]
    docs[41][1] = docs[17][1].replace(docs[17][1].split()[60], "other")
    docs[48][1] += " " + bench[0][1]
    docs[56][1] += " token=abcdef0123456789"
    sf = str(tmp_path)
    spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    want = {d: t for d, t in docs if d % 8 != 3 and d not in (40, 41, 48)}
    want[56] = want[56].replace("token=abcdef0123456789", "[assign]")
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == {d: tokenizer.encode(t, add_special_tokens=False).ids for d, t in want.items()}


@pytest.mark.parametrize("stage", range(5))
def test_stages_hold_few_texts(spark, small, stage):
    """Large texts go to Python a few megabytes at a time; a session's own setting stays."""
    import corpus_pipeline

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = spark.range(0, 24, 1, 1).selectExpr("repeat('x', 1000000) AS text")

    def sizes():
        return [r.n for r in texts.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()]

    try:
        spark.conf.unset(key)
        corpus_pipeline.STAGES[stage][1](spark, docs, small)
        assert max(sizes()) < 6_000_000
        spark.conf.set(key, "64m")
        corpus_pipeline.STAGES[stage][1](spark, docs, small)
        assert max(sizes()) > 20_000_000
    finally:
        spark.conf.unset(key)


def test_stages_keep_the_columns(spark, small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, small).columns == docs.columns


def test_stages_on_odd_and_empty_tables(spark, odd, empty, tmp_path):
    """Nulls, empty texts, repeated ids and more columns come through; empty labels and benchmark drop nothing."""
    import corpus_pipeline
    from reagentql.llm.common import Scratch

    folder = str(tmp_path)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for docs, ids in ((odd, [1, 4, 4, 5, 6, 7]), (empty, [])):
        kept = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, kept, folder)
            assert kept.columns == docs.columns, name
            kept = Scratch(spark).spill(kept)
        out = corpus_pipeline.STAGES[-1][1](spark, kept, folder)
        assert out.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]
        assert sorted(r.doc_id for r in out.collect()) == ids
    odd.write.parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 6
