"""Document quality from random-indexing word vectors and a small network.

Every word falls into one of BUCKETS buckets by hash, and every bucket has a sparse index vector
(one +1, one -1).  A bucket's context vector is the sum of the index vectors of all words that
stand within WINDOW words of it, over all documents; sums of whole numbers do not depend on how
the documents are dealt out.  The table of context vectors has BUCKETS rows whatever the size of
the corpus, which bounds what is sent to the driver and back.

A document's features are the means and deviations of its words' vectors.  A network of two
layers, fitted with numpy on a bounded sample of labelled rows, scores them, and a temperature
found on a part of the sample that the network has not seen calibrates the score.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reagentql.llm.common import BoundedCache, id_and_text, map_texts

TOKEN = re.compile(r"[^\W\d_]+|\d+|(?:[^\w\s]|_)+")
#: Hash buckets of words, and numbers in a vector.  The first bucket stands for a word that repeats the one before it.
BUCKETS, WIDTH = 1 << 14, 64
REPEAT = 0
WINDOW = 2
#: Weight of a word's own index vector beside its context vector.
OWN = 0.5
#: The most labelled documents that the network is fitted on, picked by hash of their ids; one fifth of them tunes the temperature.
SAMPLE = 20_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 60, 128, 0.003, 1e-3
#: Words of a text that are held as text at a time.
PIECE = 200_000
THRESHOLD = 0.3


def held_out(id_col: str) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text, mod 5, is 0."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """The places of +1 and of -1 in each bucket's index vector; they differ."""
    h = np.array([xxhash.xxh64_intdigest(str(i), 17) for i in range(BUCKETS)], np.uint64)
    plus, off = (h % np.uint64(WIDTH)).astype(np.int64), ((h >> np.uint64(20)) % np.uint64(WIDTH - 1)).astype(np.int64)
    return plus, (plus + 1 + off) % WIDTH


def word_buckets() -> BoundedCache:
    return BoundedCache(lambda word: xxhash.xxh64_intdigest(word, 13) % (BUCKETS - 1) + 1, 200_000)


def bucket_pieces(text: str, cache: BoundedCache) -> Iterator[np.ndarray]:
    """Buckets of the words of a text, in pieces of at most PIECE words."""
    last = -1
    words = (m.group() for m in TOKEN.finditer(text)) if len(text) > 5 * PIECE else iter(TOKEN.findall(text))
    while piece := list(itertools.islice(words, PIECE)):
        buckets = np.array([cache[w] for w in piece], np.int64)
        again = np.r_[last, buckets[:-1]] == buckets
        last = int(buckets[-1])
        yield np.where(again, REPEAT, buckets)


class Neighbours:
    """Sums of the neighbours' index vectors and numbers of words by bucket, for texts that come in pieces."""

    def __init__(self):
        self.plus, self.minus = index_vectors()
        self.sums, self.seen = np.zeros(BUCKETS * WIDTH, np.int64), np.zeros(BUCKETS, np.int64)
        self.held: list[np.ndarray] = []
        self.words = self.carried = 0

    def put(self, piece: np.ndarray) -> None:
        self.held.append(piece)
        self.words += len(piece)
        if self.words > 4 * PIECE:
            self.count()

    def end_text(self) -> None:
        self.held.append(np.full(WINDOW, -1))

    def count(self) -> None:
        """Count what is held; its last words stay as neighbours of the next."""
        if not self.held:
            return
        every = np.concatenate(self.held)
        new = every[self.carried :]
        self.seen += np.bincount(new[new >= 0], minlength=BUCKETS)
        for off in range(1, WINDOW + 1):
            start = max(0, self.carried - off)
            a, b = every[start:-off], every[start + off :]
            both = (a >= 0) & (b >= 0)
            for word, near in ((a[both], b[both]), (b[both], a[both])):
                self.sums += np.bincount(word * WIDTH + self.plus[near], minlength=len(self.sums))
                self.sums -= np.bincount(word * WIDTH + self.minus[near], minlength=len(self.sums))
        self.held, self.words, self.carried = [every[-WINDOW:]], 0, min(WINDOW, len(every))


COLUMNS = ["bucket", "n", *[f"c{i}" for i in range(WIDTH)]]


def context_table(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """bucket, n, c0, c1, ...: words in each bucket and the sum of their neighbours' index vectors, over all documents.

    Every task sends one row per bucket that it has seen, so a frequent word is a row a task.
    """

    def run(batches):
        cache, found = word_buckets(), Neighbours()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for piece in bucket_pieces(text or "", cache):
                    found.put(piece)
                found.end_text()
        found.count()
        used = np.flatnonzero(found.seen)
        sums = found.sums.reshape(BUCKETS, WIDTH)[used]
        arrays = [pa.array(used), pa.array(found.seen[used]), *[pa.array(np.ascontiguousarray(sums[:, i])) for i in range(WIDTH)]]
        yield pa.RecordBatch.from_arrays(arrays, COLUMNS)

    parts = docs.select(text_col).mapInArrow(run, ", ".join(f"{c} long" for c in COLUMNS))
    return parts.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in COLUMNS[1:]])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def word_vectors(contexts: DataFrame) -> np.ndarray:
    """One vector a bucket: the direction of its context, freed of the direction that all share, and its own index vector.

    The driver gets at most BUCKETS rows, 9 MB.
    """
    rows = contexts.select(*COLUMNS).orderBy("bucket").toArrow()
    used, n = rows["bucket"].to_numpy(), rows["n"].to_numpy().astype(float)
    sums = np.stack([rows[c].to_numpy() for c in COLUMNS[2:]], 1).astype(float)
    directions = _unit(sums)
    if len(used):
        directions = _unit(directions - (n @ directions) / n.sum())
    plus, minus = index_vectors()
    out = np.zeros((BUCKETS, WIDTH))
    out[used] = directions
    out[np.arange(BUCKETS), plus] += OWN
    out[np.arange(BUCKETS), minus] -= OWN
    return out.astype(np.float32)


class Pooler:
    """Means and deviations of the word vectors of whole texts; zeros for a text without words."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = np.concatenate([vectors, vectors * vectors], 1)
        self.cache = word_buckets()

    def pool(self, text: str) -> np.ndarray:
        counts = np.zeros(BUCKETS, np.int64)
        for piece in bucket_pieces(text, self.cache):
            counts += np.bincount(piece, minlength=BUCKETS)
        used = np.flatnonzero(counts)
        if not len(used):
            return np.zeros(2 * WIDTH, np.float32)
        share = (counts[used] / counts.sum()).astype(np.float32)
        both = share @ self.vectors[used]
        mean, square = both[:WIDTH], both[WIDTH:]
        return np.concatenate([mean, np.sqrt(np.maximum(square - mean * mean, 0))])


def train(x: np.ndarray, y: np.ndarray, seed: int = 0) -> list[np.ndarray]:
    """Weights of a network with one hidden layer, fitted to labels 0 and 1 by Adam."""
    draw = np.random.default_rng(seed)
    width = x.shape[1]
    weights = [draw.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN), draw.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(())]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(EPOCHS):
        for rows in np.array_split(draw.permutation(len(x)), max(1, len(x) // BATCH)):
            hidden = np.tanh(x[rows] @ weights[0] + weights[1])
            error = (_sigmoid(hidden @ weights[2] + weights[3]) - y[rows]) / len(rows)
            back = np.outer(error, weights[2]) * (1 - hidden * hidden)
            slopes = [x[rows].T @ back + DECAY * weights[0], back.sum(0), hidden.T @ error + DECAY * weights[2], error.sum()]
            step += 1
            for k, slope in enumerate(slopes):
                first[k] = 0.9 * first[k] + 0.1 * slope
                second[k] = 0.999 * second[k] + 0.001 * np.square(slope)
                weights[k] = weights[k] - RATE * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return weights


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def best_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of logits, from 0.5 to 20, under which labels are likeliest."""
    grid = np.geomspace(0.5, 20, 75)
    p = _sigmoid(logits[None, :] / grid[:, None])
    likely = np.log(np.where(y[None, :] == 1, p, 1 - p) + 1e-12).mean(1)
    return float(grid[int(np.argmax(likely))])


@dataclass
class QualityModel:
    vectors: np.ndarray
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: list[np.ndarray] | None = None
    temperature: float = 1.0
    prior: float = 0.5

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh((x - self.mean) / self.scale @ self.weights[0] + self.weights[1])
        return hidden @ self.weights[2] + self.weights[3]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.prior)
        return _sigmoid(self.logits(x) / self.temperature)


def _pooled(rows: DataFrame, vectors: np.ndarray) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(vectors)

    def run(batches):
        pooler = Pooler(shared.value)
        for batch in batches:
            x = np.array([pooler.pool(t) for t in batch.column(0).to_pylist()], np.float32).reshape(-1, 2 * WIDTH)
            packed = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * 2 * WIDTH, pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([packed, batch.column(1)], ["x", "quality"])

    return rows.select("text", "quality").mapInArrow(run, "x array<float>, quality int")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> QualityModel:
    """A model with word vectors of all documents, and a network of at most ``sample`` labelled ones outside the held-out fifth.

    Four fifths of the sample fit the network, one fifth its temperature.  Equal texts with equal
    labels count once.  Labels of null ids or null values teach nothing; a document with several
    labels is good only if all of them say so.  Without documents of both labels every score is
    the share of good ones, without any labels 0.5.  The driver gets the table of word vectors
    and 2 * WIDTH numbers for each document of the sample, none of which grow with the corpus.
    """
    vectors = word_vectors(context_table(docs, text_col))
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out("doc_id"))
    known = known.groupBy("doc_id").agg(F.min((F.col("quality") == 1).cast("int")).alias("quality"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = id_and_text(docs, id_col, text_col).join(F.broadcast(picked), "doc_id")
    rows = _pooled(texts, vectors).toArrow()
    x = rows["x"].combine_chunks().flatten().to_numpy().reshape(-1, 2 * WIDTH).astype(float)
    every = np.unique(np.column_stack([x, rows["quality"].to_numpy()]), axis=0) if len(x) else np.zeros((0, 2 * WIDTH + 1))
    every = np.random.default_rng(1).permutation(every)
    x, y = every[:, :-1], every[:, -1]
    if not 0 < y.sum() < len(y):
        return QualityModel(vectors, prior=float(y.mean()) if len(y) else 0.5)
    tune = np.arange(len(y)) % 5 == 4
    if not 0 < y[~tune].sum() < (~tune).sum():
        tune[:] = False
    model = QualityModel(vectors, x[~tune].mean(0), x[~tune].std(0) + 1e-6)
    model.weights = train((x[~tune] - model.mean) / model.scale, y[~tune])
    if tune.any():
        model.temperature = best_temperature(model.logits(x[tune]), y[tune])
    return model


def _scorer(docs: DataFrame, model: QualityModel):
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value
        pooler = Pooler(model.vectors)

        def score(texts: list[str | None]) -> np.ndarray:
            x = np.array([pooler.pool(t or "") for t in texts], np.float32).reshape(-1, 2 * WIDTH)
            return model.probabilities(x.astype(float))

        return score

    return make


def score_documents(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1, higher: likelier good) for every row.

    Null and empty texts, and those without words, are all zeros to the network, and score alike.
    Repeated rows give repeated results, an empty table none; texts of any length are read whole.
    """
    scorer = _scorer(docs, model)

    def make():
        score = scorer()
        return lambda ids, texts: [pa.RecordBatch.from_arrays([ids, pa.array(score(texts), pa.float64())], ["doc_id", "score"])]

    rows = id_and_text(docs, id_col, text_col)
    return map_texts(rows, make, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def drop_poor(docs: DataFrame, model: QualityModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score at least the threshold; copies stay or go together."""
    scorer = _scorer(docs, model)

    def run(batches):
        score = scorer()
        for batch in batches:
            yield batch.filter(pa.array(score(batch.column(text_col).to_pylist()) >= threshold))

    return docs.mapInArrow(run, docs.schema)
