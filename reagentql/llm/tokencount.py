"""Exact token counts at every prefix of a text, by dynamic programming.

For byte-pair vocabularies the encoding of a prefix is the encoding of a shorter prefix
plus one last token: the only vocabulary token that ends there and that stays apart from
the token before it when both are merged exactly.  So one pass over the characters gives
the count of *every* prefix, and questions on truncation and budgets are answered from
the stored counts without encoding anything again.

A text falls apart at characters that no vocabulary piece joins (before a word's space
mark and around line breaks), and the counts of each part are cached.
"""

from __future__ import annotations

import functools
import heapq
import re
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reagentql.llm.common import BoundedCache, id_and_text, map_texts

SPACE = "▁"
DEFAULT_MODEL = "piece_bpe_32k.model"
#: Entries of a worker's cache of words.
CACHE_WORDS = 500_000


def model_path(path: str | None, default: str) -> str:
    """The tokenizer file; without a path, the public one of that name on this machine."""
    if path is not None:
        return path
    import public_tokenizers

    return public_tokenizers.path(default)


@functools.lru_cache(1)
def prefix_counter(path: str) -> PrefixCounter:
    """One counter for all tasks of a worker process."""
    return PrefixCounter(path)


class PrefixCounter:
    """Token counts of all prefixes under a sentencepiece BPE model with byte fallback."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [
            i for i in range(len(model)) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))
        ]
        #: Piece to merge priority: the higher the score, the earlier it is merged.
        self.score = {model.id_to_piece(i): model.get_score(i) for i in plain}
        self.pieces = list(self.score)
        automaton = ahocorasick.Automaton()
        for token, piece in enumerate(self.pieces):
            automaton.add_word(piece, (token, len(piece)))
        automaton.make_automaton()
        self.find = automaton.iter
        joined = any(SPACE in p.lstrip(SPACE) for p in self.score)
        line = any("\n" in p for p in self.score)
        self.split = None if joined or line else re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
        self.pairs: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.words = BoundedCache(self._word, CACHE_WORDS)

    def merge(self, text: str) -> list[str]:
        """Exact merging: the best-scored adjacent pair first, the leftmost of equals."""
        parts = list(text)
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        score, heap = self.score, []

        def offer(i: int, j: int) -> None:
            if 0 <= i and j < len(parts) and (s := score.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-s, i, j, parts[i] + parts[j]))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if parts[i] is None or parts[j] is None or after[i] != j or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, None
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [p for p in parts if p is not None]

    def _apart(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are when merged side by side."""
        code = left << 32 | right
        if (known := self.pairs.get(code)) is None:
            if len(self.pairs) >= 1_000_000:
                self.pairs.clear()
            a, b = self.pieces[left], self.pieces[right]
            known = self.pairs[code] = self.merge(a + b) == [a, b]
        return known

    def _single(self, token: int) -> bool:
        if (known := self.whole.get(token)) is None:
            known = self.whole[token] = self.merge(self.pieces[token]) == [self.pieces[token]]
        return known

    def counts(self, word: str) -> list[int]:
        """Token counts of word[:0], word[:1], ... by the prefix recurrence.

        The automaton names the pieces that end at each place; exactly one of them follows
        its predecessor without merging.  A character that no piece holds falls back to
        its bytes and merges with nothing.
        """
        n, pairs, done = len(word), self.pairs, 0
        count, last = [0] * (n + 1), [-1] * (n + 1)
        for end, (token, size) in self.find(word):
            if end < done:
                continue
            while done < end:
                count[done + 1] = count[done] + len(word[done].encode())
                done += 1
            start = end + 1 - size
            before = last[start]
            if before < 0:
                fits = self._single(token)
            elif (fits := pairs.get(before << 32 | token)) is None:
                fits = self._apart(before, token)
            if fits:
                done = end + 1
                count[done] = count[start] + 1
                last[done] = token
        while done < n:
            count[done + 1] = count[done] + len(word[done].encode())
            done += 1
        return count

    def _word(self, word: str) -> bytes:
        return bytes([(b - a) & 255 for a, b in pairwise(self.counts(word))])  # as int8

    def steps(self, text: str) -> np.ndarray:
        """For each character the change of the count by it, as int8; their sums are the counts."""
        if not text:
            return np.zeros(0, np.int8)
        marked = SPACE + text.replace(" ", SPACE)  # the model adds one space in front
        words = self.split.findall(marked) if self.split else [marked]
        cache = self.words
        joined = np.frombuffer(b"".join([cache[w] for w in words]), np.int8)
        out = joined[1:].copy()
        out[0] += joined[0]
        return out


def prefix_token_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, prefix_steps for every row of ``docs``.

    prefix_steps has one signed byte per character (code point); the sum of the first n is
    the exact number of tokens of the text's first n characters.  ``tokens_at`` and
    ``longest_within`` read it.  A null text counts as empty: 0 tokens, empty steps.
    Texts of any length are counted whole.  Repeated rows give repeated results, an empty table
    none; other columns of ``docs`` are not read.
    """

    def make():
        counter = prefix_counter(model_path(model, DEFAULT_MODEL))

        def run(ids, texts):
            steps = [counter.steps(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array([int(s.sum(dtype=np.int64)) for s in steps], pa.int64()),
                    pa.array([s.tobytes() for s in steps], pa.binary()),
                ],
                ["doc_id", "n_bytes", "n_tokens", "prefix_steps"],
            )

        return run

    rows = id_and_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_texts(rows, make, f"doc_id {kind}, n_bytes long, n_tokens long, prefix_steps binary")


def tokens_at(steps: bytes, n_chars: int) -> int:
    """Tokens of the text's first ``n_chars`` characters."""
    return int(np.frombuffer(steps, np.int8)[:n_chars].sum(dtype=np.int64))


def longest_within(steps: bytes, budget: int) -> int:
    """The most leading characters whose own encoding has at most ``budget`` tokens."""
    fits = np.flatnonzero(np.cumsum(np.frombuffer(steps, np.int8), dtype=np.int64) <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def truncate_to_budget(
    docs: DataFrame, budget: int, id_col: str = "doc_id", text_col: str = "text", model: str | None = None
) -> DataFrame:
    """doc_id, n_tokens, cut (characters kept), cut_tokens for a token budget, from the stored counts.

    The cut is the longest prefix that fits, not the first that is about to overflow: one more
    character can make fewer tokens.  Null and empty texts, and all texts where the budget is
    below every prefix's count, keep 0 characters.  Repeated rows give repeated results, an
    empty table none; other columns of ``docs`` are not read.
    """

    @F.pandas_udf("struct<cut:int,cut_tokens:int>")
    def answer(steps):
        import pandas as pd

        cuts = [longest_within(s, budget) for s in steps]
        return pd.DataFrame({"cut": cuts, "cut_tokens": [tokens_at(s, c) for s, c in zip(steps, cuts)]})

    counted = prefix_token_counts(docs, id_col, text_col, model)
    return counted.select("doc_id", "n_tokens", answer("prefix_steps").alias("a")).select("doc_id", "n_tokens", "a.*")
