"""Toxic passages as maximum-scoring segments of token log-odds.

Tokens are words with their beginnings and endings (so unseen forms of a known stem
count).  Each feature's log-odds between toxic and other labelled documents has a
Dirichlet prior, and its score is the lower end of the interval around it.  A token is
worth its best feature, and every token costs a small drift.  One linear scan (Ruzzo and
Tompa) finds all maximal segments of a document.  Under the drift the best segment of a
harmless text of n tokens follows an extreme-value law with scale 1/lambda and location
ln(K n)/lambda; what each segment has beyond it is summed and turned into a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reagentql.llm.common import BoundedCache, cut, id_and_text, map_texts

TOKEN = re.compile(r"[^\W\d_]+")
#: The most labelled documents that the model is fitted on, picked by hash of their ids.
SAMPLE = 20_000
DRIFT = 0.1
#: Interval half-width in standard deviations, and the least score that enters the lexicon.
SURE, LEAST = 1.64, 1.0
THRESHOLD = 0.3


def features(word: str) -> list[str]:
    """The word, and the first and last four and five letters of longer ones."""
    out = [word]
    if len(word) > 4:
        out += ["^" + word[:4], word[-4:] + "$"]
    if len(word) > 5:
        out += ["^" + word[:5], word[-5:] + "$"]
    return out


def segments(positive: list[tuple[int, float]], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, last token, score) in linear time.

    ``positive`` lists the tokens above zero as (position, score); each token costs ``drift``.
    """
    found: list[list[float]] = []  # first, last, total before, total after
    total, at = 0.0, -1
    for position, score in positive:
        total -= drift * (position - at - 1)
        new = [position, position, total, total + score - drift]
        total, at = new[3], position
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j -= 1
            if j < 0 or found[j][3] >= new[3]:
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:]
    return [(int(a), int(b), right - left) for a, b, left, right in found]


@dataclass
class ToxicityModel:
    lexicon: dict[str, float] = field(default_factory=dict)
    scale: float = 1.0  # lambda
    constant: float = 0.1  # K
    slope: float = 0.0
    intercept: float = -20.0

    def evidence(self, n: int, found: list[tuple[int, int, float]]) -> float:
        """Sum over segments of what they have beyond the extreme expected of n harmless tokens."""
        base = math.log(max(self.constant * n, 1.0))
        return sum(max(0.0, self.scale * s - base) for _, _, s in found)

    def probability(self, evidence: float) -> float:
        x = self.intercept + self.slope * math.log1p(evidence)
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))


class Scanner:
    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.words = BoundedCache(self._word, 200_000)

    def _word(self, word: str) -> float:
        return max([self.lexicon.get(f, 0.0) for f in features(word)])

    def scan(self, text: str) -> tuple[int, list[tuple[int, float]]]:
        """Number of tokens, and those with a score."""
        words, worth = TOKEN.findall(text.lower()), self.words
        return len(words), [(i, s) for i, s in enumerate([worth[w] for w in words]) if s]


def held_out(id_col: str) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text, mod 4, is 2."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def _count_features(rows: DataFrame) -> DataFrame:
    """feature, y1, y0: numbers of toxic and other texts with each feature."""

    def run(batches):
        counts = Counter(), Counter()
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                counts[toxic].update({f for w in set(TOKEN.findall(text.lower())) for f in features(w)})
            if len(counts[0]) + len(counts[1]) > 300_000:
                yield from _pack(counts)
                counts = Counter(), Counter()
        yield from _pack(counts)

    def _pack(counts):
        names = list(counts[0].keys() | counts[1].keys())
        columns = [pa.array(names, pa.string()), *(pa.array([counts[k][f] for f in names], pa.int64()) for k in (1, 0))]
        yield pa.RecordBatch.from_arrays(columns, ["feature", "y1", "y0"])

    parts = rows.select("text", "toxic").mapInArrow(run, "feature string, y1 long, y0 long")
    return parts.groupBy("feature").agg(F.sum("y1").alias("y1"), F.sum("y0").alias("y0"))


def _lexicon(rows: DataFrame) -> dict[str, float]:
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return {}
    share = (F.col("y1") + F.col("y0")) / (n1 + n0)
    a, b = F.col("y1") + 0.5 + share, F.col("y0") + 0.5 + share
    odds = F.log(a / (n1 + 1 - F.col("y1"))) - F.log(b / (n0 + 1 - F.col("y0")))
    scored = _count_features(rows).where("y1 > 1").select("feature", (odds - SURE * F.sqrt(1 / a + 1 / b)).alias("s"))
    return {r["feature"]: round(r["s"], 4) for r in scored.where(F.col("s") >= LEAST).collect()}


def _scale(scores: list[tuple[float, int]], tokens: int) -> float:
    """The positive root of mean(exp(lambda * score)) = 1 over the tokens of harmless texts.

    ``scores`` lists each score above zero with its number of tokens.
    """
    if not scores or not tokens:
        return 1.0
    gain, times = np.array([s for s, _ in scores]) - DRIFT, np.array([n for _, n in scores])
    rest = (tokens - int(times.sum())) / tokens
    low, high = 1e-6, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        mean = rest * math.exp(-mid * DRIFT) + float((times * np.exp(np.minimum(mid * gain, 700))).sum()) / tokens
        low, high = (mid, high) if mean < 1 else (low, mid)
    return max(low, 0.05)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton's method with a weak ridge."""
    design, w = np.stack([x, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        hessian = design.T @ (design * (p * (1 - p))[:, None]) + np.diag([0.05, 0.005])
        step = np.linalg.solve(hessian, design.T @ (y - p) - np.array([0.05, 0.005]) * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(max(w[0], 0.0)), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> ToxicityModel:
    """A model from at most ``sample`` labelled documents outside the held-out quarter.

    Four fifths of them make the lexicon, one fifth the calibration.  Copies of a text count
    once.  Without documents of both labels the model finds nothing toxic.  Labels of null ids
    or null values teach nothing; a document with several labels counts as toxic if one says so.

    The driver gets the lexicon, the scores in it with their counts, and three numbers for each
    text of the calibration: all bounded by ``sample``, none by the texts' lengths.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out("doc_id"))
    known = known.groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = id_and_text(docs, id_col, text_col).join(F.broadcast(picked), "doc_id")
    texts = texts.groupBy(F.xxhash64("text").alias("h"), "toxic").agg(F.first("text").alias("text"))
    texts = cut(texts.select("text", "toxic", (F.pmod("h", F.lit(5)) == 0).alias("tune")))
    lexicon = _lexicon(texts.where("not tune"))
    if not lexicon:
        return ToxicityModel()
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        scanner = Scanner(shared.value)
        for batch in batches:
            found = [scanner.scan(t) for t in batch.column("text").to_pylist()]
            best = [max([s for *_, s in segments(hits)], default=None) for _, hits in found]
            counts = [[{"score": s, "times": k} for s, k in Counter(s for _, s in hits).items()] for _, hits in found]
            kind = pa.list_(pa.struct([("score", pa.float64()), ("times", pa.int64())]))
            columns = [batch.column("toxic"), pa.array([n for n, _ in found], pa.int64()), pa.array(best, pa.float64()), pa.array(counts, kind)]
            yield pa.RecordBatch.from_arrays(columns, ["toxic", "n", "best", "counts"])

    tune = texts.where("tune").select("text", "toxic")
    scanned = cut(tune.mapInArrow(run, "toxic int, n long, best double, counts array<struct<score:double,times:long>>"))
    harmless = scanned.where("toxic = 0")
    scores = harmless.select(F.explode("counts").alias("c")).groupBy("c.score").agg(F.sum("c.times").alias("times")).orderBy("score").collect()
    sizes = sorted((r["n"], r["best"]) for r in harmless.select("n", F.coalesce("best", F.lit(-1.0)).alias("best")).collect())
    model = ToxicityModel(lexicon)
    model.scale = _scale([(r["score"], r["times"]) for r in scores], sum(n for n, _ in sizes))
    best = [(s, n) for n, s in sizes if s > 0]
    if best:
        # Mean of a Gumbel law: location plus Euler's constant times the scale.
        model.constant = math.exp(sum(model.scale * s - math.log(n) for s, n in best) / len(best) - 0.5772156649)
    fitted = docs.sparkSession.sparkContext.broadcast(model)

    def weigh(batches):
        model = fitted.value
        scanner = Scanner(model.lexicon)
        for batch in batches:
            found = [scanner.scan(t) for t in batch.column("text").to_pylist()]
            evidence = [model.evidence(n, segments(hits)) for n, hits in found]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(evidence, pa.float64())], ["toxic", "evidence"])

    weighed = sorted((r["evidence"], r["toxic"]) for r in tune.mapInArrow(weigh, "toxic int, evidence double").collect())
    x = np.array([math.log1p(e) for e, _ in weighed])
    y = np.array([float(t) for _, t in weighed])
    if len(weighed) and 0 < y.sum() < len(y):
        model.slope, model.intercept = _logistic(x, y)
    else:
        model.slope, model.intercept = 4.0, -4.0
    return model


def _scorer(docs: DataFrame, model: ToxicityModel):
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value
        scanner = Scanner(model.lexicon)

        def score(text: str) -> tuple[float, list[tuple[int, int, float]]]:
            n, hits = scanner.scan(text)
            found = segments(hits)
            return model.probability(model.evidence(n, found)), found

        return score

    return make


def score_documents(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1), passages (start, end in tokens, end exclusive, score) for every row.

    Null and empty texts get the score of no evidence.  Repeated rows give repeated results, an
    empty table none; texts of any length are scanned whole.
    """
    scorer = _scorer(docs, model)

    def make():
        score = scorer()

        def run(ids, texts):
            found = [score(t) for t in texts]
            passages = pa.array(
                [[{"start": a, "end": b + 1, "score": round(s, 6)} for a, b, s in p] for _, p in found],
                pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])),
            )
            yield pa.RecordBatch.from_arrays([ids, pa.array([p for p, _ in found], pa.float64()), passages], ["doc_id", "score", "passages"])

        return run

    rows = id_and_text(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_texts(rows, make, f"doc_id {kind}, score double, passages array<struct<start:int,end:int,score:double>>")


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score below the threshold.

    Null and empty texts have no evidence and stay; rows that repeat a text stay or go together;
    an empty table gives no rows.
    """
    scorer = _scorer(docs, model)

    def run(batches):
        score = scorer()
        for batch in batches:
            keep = [score(t or "")[0] < threshold for t in batch.column(text_col).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
