"""Token counts and byte BPE against the libraries, whole texts and prefixes."""

from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from reagentql.llm import bytebpe, queries, tokencount
from tests.llm.conftest import ODD


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def byte_level():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_counts_of_every_prefix(pieces):
    counter = tokencount.PrefixCounter(public_tokenizers.path("piece_bpe_32k.model"))
    for text in ("", " ", "a  b\nc▁d", "Hello there, wörld 12345 日本 😀!", "aaaaabababab" * 9, "<s> x </s>"):
        counts = np.cumsum(counter.steps(text), dtype=int).tolist()
        assert counts == [len(pieces.encode(text[: i + 1])) for i in range(len(text))]


def test_counts_of_whole_texts(spark, odd, pieces):
    got = sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in tokencount.prefix_token_counts(odd).collect())
    assert got == sorted((d, len((t or "").encode()), len(pieces.encode(t or ""))) for d, t, *_ in ODD)


def test_budget_questions(spark, odd, pieces):
    texts = {d: t or "" for d, t, *_ in ODD}
    for r in tokencount.truncate_to_budget(odd, 7).collect():
        text = texts[r.doc_id]
        assert r.cut_tokens == len(pieces.encode(text[: r.cut])) <= 7
        assert all(len(pieces.encode(text[:n])) > 7 for n in range(r.cut + 1, min(r.cut + 40, len(text)) + 1))


def test_budgets_that_cut_all_or_nothing(spark, odd, empty):
    lengths = sorted((d, len(t or "")) for d, t, *_ in ODD)
    rows = tokencount.truncate_to_budget(odd, 10**9).collect()
    assert sorted((r.doc_id, r.cut) for r in rows) == lengths and all(r.cut_tokens == r.n_tokens for r in rows)
    for budget in (0, -1):
        rows = tokencount.truncate_to_budget(odd, budget).collect()
        assert len(rows) == len(ODD) and all(r.cut_tokens <= 0 for r in rows)
        assert {r.doc_id: r.cut for r in rows if r.doc_id != 3} == {d: 0 for d, *_ in ODD if d != 3}
    assert tokencount.truncate_to_budget(empty, 5).collect() == []


def test_query_op1(spark, small, pieces):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = queries.op1_token_counts(spark, small).collect()
    assert {r.doc_id: (r.n_tokens, r.over_limit) for r in rows} == {d: (n := len(pieces.encode(t)), n > 4096) and (len(pieces.encode(t)), len(pieces.encode(t)) > 4096) for d, t in docs.items()}


def test_encoding_and_round_trip(spark, odd, byte_level):
    got = sorted((r.doc_id, list(r.ids), r.decoded) for r in bytebpe.encode_decode(odd).collect())
    want = [(d, byte_level.encode(t or "", add_special_tokens=False).ids) for d, t, *_ in ODD]
    assert got == sorted((d, ids, byte_level.decode(ids, skip_special_tokens=False)) for d, ids in want)


def test_query_op4(spark, small, byte_level):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in queries.op4_byte_bpe(spark, small).collect():
        ids = byte_level.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(byte_level.decode(ids, skip_special_tokens=False)))


def test_long_words_merge_alike():
    bpe = bytebpe.SpeculativeBpe(public_tokenizers.path("byte_bpe_50k.json"))
    for word in (b"a" * 33, b"internationalization" * 5, b"=-" * 40):
        assert bpe.merge(word) == bpe.merge_long(word)


def test_empty(spark, empty):
    assert tokencount.prefix_token_counts(empty).collect() == [] == bytebpe.encode_decode(empty).collect()
