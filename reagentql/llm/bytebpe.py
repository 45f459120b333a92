"""Byte-level BPE: propose by greedy longest match, verify all adjacent pairs, repair the rest.

A sequence of tokens is the BPE encoding of a word exactly if every two neighbours stay
apart when their bytes are merged alone.  So the encoder proposes tokens greedily, tests
all neighbouring pairs of all new words of a batch at once (one numpy lookup of pair
codes; a pair is merged exactly once and remembered), and merges only the words in which
a pair fails.
"""

from __future__ import annotations

import functools
import json
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from reagentql.llm.common import id_and_text, map_texts
from reagentql.llm.tokencount import model_path

DEFAULT_VOCABULARY = "byte_bpe_50k.json"
#: Entries of a worker's cache of words.
CACHE_WORDS = 250_000
#: The vocabulary's fixed way to cut a text into words (fixed value).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def byte_letters() -> dict[str, int]:
    """The printable letter of each byte in byte-level vocabularies, as letter to byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


#: Above every rank of a merge.
NEVER = 1 << 30


@functools.lru_cache(1)
def speculative_bpe(path: str) -> SpeculativeBpe:
    """One encoder for all tasks of a worker process."""
    return SpeculativeBpe(path)


class SpeculativeBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.id_of = {raw(t): i for t, i in vocab.items() if t not in self.special}
        n = 1 + max(*vocab.values(), *self.special.values())
        self.bytes_of = [b""] * n
        for token, i in self.id_of.items():
            self.bytes_of[i] = token
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        merges = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.rank, self.made = {}, []
        for rank, (a, b) in enumerate(merges):
            a, b = raw(a), raw(b)
            self.rank[self.id_of[a], self.id_of[b]] = rank
            self.made.append(self.id_of[a + b])
        self.longest = max(map(len, self.id_of))
        self.words_of = regex.compile(WORDS).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.apart_known: dict[int, bool] = {}
        self.single: dict[int, bool] = {}
        self.cache: dict[str, bytes] = {}

    def merge(self, word: bytes) -> list[int]:
        """Exact merging of one word: the lowest rank first, the leftmost of equals."""
        ids = [self.id_of[word[i : i + 1]] for i in range(len(word))]
        get, made = self.rank.get, self.made
        ranks = [get(p, NEVER) for p in pairwise(ids)]
        while ranks and (best := min(ranks)) < NEVER:
            i = ranks.index(best)
            ids[i : i + 2] = [made[best]]
            del ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), NEVER)
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), NEVER)
        return ids

    def merge_long(self, word: bytes) -> list[int]:
        """The same for long words, with a heap instead of a scan for each merge."""
        import heapq

        ids = [self.id_of[word[i : i + 1]] for i in range(len(word))]
        n, rank = len(ids), self.rank
        after, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []

        def offer(i, j):
            if i >= 0 and j < n and (r := rank.get((ids[i], ids[j]))) is not None:
                heapq.heappush(heap, (r, i, j, ids[i], ids[j]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            r, i, j, a, b = heapq.heappop(heap)
            if ids[i] != a or ids[j] != b or after[i] != j:
                continue
            ids[i], ids[j], after[i] = self.made[r], -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [x for x in ids if x >= 0]

    def exact(self, word: bytes) -> list[int]:
        return self.merge(word) if len(word) <= 32 else self.merge_long(word)

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match from the left."""
        get, out, at, n = self.id_of.get, [], 0, len(word)
        while at < n:
            for end in range(min(n, at + self.longest), at, -1):
                if (i := get(word[at:end])) is not None:
                    out.append(i)
                    at = end
                    break
        return out

    def _stays(self, code: int) -> bool:
        if (known := self.apart_known.get(code)) is None:
            if len(self.apart_known) >= 600_000:
                self.apart_known.clear()
            a, b = code >> 32, code & 0xFFFFFFFF
            known = self.apart_known[code] = self.exact(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def _alone(self, i: int) -> bool:
        if (known := self.single.get(i)) is None:
            known = self.single[i] = self.exact(self.bytes_of[i]) == [i]
        return known

    def learn(self, words: list[str]) -> None:
        """Encode the new words of a batch together and put them into the cache."""
        raw = [w.encode() for w in words]
        proposed = [self.propose(w) for w in raw]
        sizes = np.fromiter(map(len, proposed), np.int64, len(words))
        flat = np.fromiter((i for ids in proposed for i in ids), np.int64, int(sizes.sum()))
        ends = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(words)), sizes)
        inner = owner[:-1] == owner[1:]
        codes = (flat[:-1][inner] << 32) | flat[1:][inner]
        kinds, which = np.unique(codes, return_inverse=True)
        good = np.fromiter(map(self._stays, kinds.tolist()), bool, len(kinds))
        bad = np.zeros(len(words), bool)
        bad[owner[:-1][inner][~good[which]]] = True
        for k in np.flatnonzero(sizes == 1):
            bad[k] |= not self._alone(proposed[k][0])
        flat = flat.astype(np.int32)
        for k, (word, end) in enumerate(zip(words, ends.tolist())):
            ids = np.array(self.exact(raw[k]), np.int32) if bad[k] else flat[end - sizes[k] : end]
            self.cache[word] = ids.tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian int32 bytes."""
        cut: list[list[list[str] | int]] = []
        new: set[str] = set()
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        cache = self.cache
        for text in texts:
            parts: list[list[str] | int] = []
            pieces = self.cut.split(text) if self.cut and any(s in text for s in self.special) else [text]
            for piece in pieces:
                if piece in self.special:
                    parts.append(self.special[piece])
                elif piece:
                    words = self.words_of(piece)
                    new |= set(words).difference(cache)
                    parts.append(words)
            cut.append(parts)
        if new:
            self.learn(list(new))
        out = [
            b"".join([p.to_bytes(4, "little") if isinstance(p, int) else b"".join([cache[w] for w in p]) for p in parts])
            for parts in cut
        ]
        # Only words of bounded length stay, so the cache is bounded in bytes.
        for w in new:
            if len(w) > LONG_WORD:
                del cache[w]
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.bytes_of[i] for i in ids]).decode("utf-8", "replace")


#: Letters of the longest word that stays in the cache.
LONG_WORD = 64
#: Texts that are encoded together; bounds the words held at once.
BLOCK_CHARS = 2_000_000


def blocks(texts: list[str], most: int = BLOCK_CHARS):
    """Index ranges of about ``most`` characters each."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode_decode(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None
) -> DataFrame:
    """doc_id, ids (array<int>), decoded (string) for every row of ``docs``.

    Strings of special tokens inside a text become their ids, as the vocabulary file's own
    library does by default.  ``decoded`` is decoded from ``ids``.  A null text counts as
    empty: no ids, empty string.  Texts of any length are coded whole.  Repeated rows give
    repeated results, an empty table none; other columns of ``docs`` are not read.
    """

    def make():
        bpe = speculative_bpe(model_path(vocabulary, DEFAULT_VOCABULARY))

        def run(doc_ids, texts):
            for a, b in blocks(texts):
                coded = bpe.encode(texts[a:b])
                sizes = np.fromiter(map(len, coded), np.int64, b - a) // 4
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                values = np.frombuffer(b"".join(coded), np.int32)
                decoded = [bpe.decode(values[s:e].tolist()) for s, e in pairwise(offsets.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [doc_ids[a:b], pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)), pa.array(decoded, pa.string())],
                    ["doc_id", "ids", "decoded"],
                )

        return run

    rows = id_and_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_texts(rows, make, f"doc_id {kind}, ids array<int>, decoded string")
