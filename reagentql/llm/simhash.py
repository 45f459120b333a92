"""SimHash near-duplicates, linked through Golay-code keys.

A fingerprint is cut into three segments of at most 23 bits.  The binary Golay code has a
codeword within three bits of every 23-bit word, so a segment is named by the indices of
the codewords near it: one if a codeword is within two bits, else six.  Two segments that
differ in one bit always share an index.  With two errors in three segments, one segment
is free of errors and the next one (in a cycle) has at most one; a key is therefore an
exact segment with an index of the next.  Rows of equal keys are compared in full.

A key shared by many fingerprints is not expanded into pairs: its fingerprints list all
their one-bit neighbours instead, and those that meet in a neighbour (at most 65) differ
by two bits or fewer.
"""

from __future__ import annotations

import functools
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reagentql.llm.common import cut, id_and_text, join_on_hot, map_texts
from reagentql.llm.graph import components

SEED = 42
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
GENERATOR = 0xC75  # fixed value: the Golay code's generating polynomial
#: (lowest bit, bits) of the three segments of a 64-bit fingerprint.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fingerprints of one key that are compared in pairs; more go through one-bit neighbours.
BUCKET = 16


def shingle_hashes(text: str, size: int, seed: int = SEED) -> list[int]:
    """XXH64 of each shingle of ``size`` words; of the whole sequence if it is shorter."""
    words = WORD.findall(text.encode().lower())
    if not words:
        return []
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return [digest(b" ".join(words), seed)]
    joined = b" ".join(words)
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=starts[1:])
    ends = (starts[size:] - 1).tolist()
    return [digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends)]


def majority(hashes: np.ndarray) -> np.ndarray:
    """Per bit (lowest first), whether over half of the 64-bit hashes have it."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        block = hashes[at : at + 65536]
        total += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return total * 2 > len(hashes)


def fingerprint(text: str, size: int = 3) -> int:
    """The 64-bit SimHash of a text as a signed integer; zero without words."""
    hashes = np.array(shingle_hashes(text, size), np.uint64)
    return int(np.packbits(majority(hashes), bitorder="little").view(np.int64)[0]) if len(hashes) else 0


def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator."""
    out = words.astype(np.int64)
    for bit in range(22, 10, -1):
        out = np.where(out >> bit & 1, out ^ GENERATOR << bit - 11, out)
    return out


@functools.lru_cache(1)
def error_table() -> np.ndarray:
    """For each of the 2,048 syndromes up to six error patterns that lead to codewords, -1 padded.

    One pattern of at most three bits; where it has three, also the five of four bits.
    """
    table = np.full((2048, 6), -1, np.int64)
    used = np.zeros(2048, np.int64)
    weight = np.zeros(2048, np.int64)
    for bits in range(5):
        patterns = np.array([sum(1 << b for b in c) for c in combinations(range(23), bits)], np.int64)
        for pattern, s in zip(patterns.tolist(), syndromes(patterns).tolist()):
            if bits < 4 or weight[s] == 3:
                table[s, used[s]] = pattern
                used[s] += 1
                weight[s] = bits if bits < 4 else 3
    return table


def codeword_indices(segments: np.ndarray) -> np.ndarray:
    """Indices (12 bits) of the codewords near each 23-bit segment; -1 where there are fewer than six."""
    errors = error_table()[syndromes(segments)]
    return np.where(errors >= 0, (segments[:, None] ^ errors) >> 11, -1)


def golay_keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys of all fingerprints (int64)."""
    bits = fingerprints.view(np.uint64)
    segments = [((bits >> np.uint64(low)) & np.uint64((1 << n) - 1)).astype(np.int64) for low, n in SEGMENTS]
    rows, keys = [], []
    for k in range(3):
        near = codeword_indices(segments[(k + 1) % 3])
        key = np.where(near >= 0, ((np.int64(k) << 22 | segments[k])[:, None] << 12) | near, -1)
        row, col = np.nonzero(near >= 0)
        rows.append(row)
        keys.append(key[row, col])
    return np.concatenate(rows), np.concatenate(keys)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id, fp (long) for every row; a null text counts as empty and has fingerprint zero."""

    def make():
        def run(ids, texts):
            yield pa.RecordBatch.from_arrays([ids, pa.array([fingerprint(t, shingle) for t in texts], pa.int64())], ["doc_id", "fp"])

        return run

    return map_texts(id_and_text(docs, id_col, text_col), make, "doc_id long, fp long")


def links_within_two(prints: DataFrame) -> DataFrame:
    """Links a, b between nodes of ``prints`` (node, fp; fps distinct) that connect all at two bits or fewer.

    Every such pair is linked directly or through fingerprints that are themselves within
    two bits of both.
    """

    def keyed(batches):
        for batch in batches:
            if batch.num_rows:
                node, fp = batch.column("node").to_numpy(), batch.column("fp").to_numpy()
                row, key = golay_keys(fp)
                for at in range(0, len(row), 50_000):
                    r = row[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key[at : at + 50_000]), pa.array(node[r]), pa.array(fp[r])], ["key", "node", "fp"]
                    )

    keys = prints.select("node", "fp").mapInArrow(keyed, "key long, node long, fp long")
    counts = cut(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shared = join_on_hot(keys, counts.withColumn("many", F.col("n") > BUCKET), "key", total)
    few = shared.where("not many").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("node", "fp"))).alias("m"))
    pairs = few.select(F.posexplode("m").alias("i", "x"), "m").select(
        F.col("x.node").alias("a"),
        F.explode(F.filter("m", lambda y: (y["node"] > F.col("x.node")) & (F.bit_count(y["fp"].bitwiseXOR(F.col("x.fp"))) <= 2))).alias("y"),
    )
    near = F.concat(
        F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    )
    many = shared.where("many").select("node", "fp").distinct()
    meet = many.select("node", F.explode(near).alias("z")).groupBy("z").agg(F.sort_array(F.collect_list("node")).alias("m")).where(F.size("m") > 1)
    stars = meet.select(F.col("m")[0].alias("a"), F.explode(F.slice("m", 2, 64)).alias("b"))
    return pairs.select("a", F.col("y.node").alias("b")).union(stars).distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id, fp (long), component_id (smallest id reachable over links of two bits or fewer).

    Every row of ``docs`` gives a row.  Equal fingerprints, among them the zero of texts
    without words, are linked like any others.  Ids are whole numbers; a row without an id gets
    the component of its fingerprint, null where no other row has that fingerprint.  Rows that
    repeat an id each give a row.  An empty table gives no rows.
    """
    marked = cut(fingerprints(docs, id_col, text_col, shingle))
    counted = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")))
    prints = counted.where("node IS NOT NULL").select("fp", "node")
    joined = components(links_within_two(prints))
    # Rows of a frequent fingerprint, such as the zero of texts without words, are dealt over many tasks.
    info = cut(counted.join(joined, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"), "n"))
    total = info.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return join_on_hot(marked, info, "fp", total).select("doc_id", "fp", "component_id")
