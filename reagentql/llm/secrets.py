"""Secret scan: known shapes, and high-entropy stretches found by a sliding window.

Known shapes are credential assignments, access key ids and long hex strings.  Beyond
them every long unbroken run of key characters is a candidate: a window slides over it
and its Shannon entropy is kept up to date by the counts of the character that enters and
the one that leaves.  Each character class has its own threshold, and an allow list
suppresses harmless candidates such as UUIDs and placeholders.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from reagentql.llm.common import SPANS, id_and_text, map_texts, span_arrays

# The known shapes.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "entropy")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
WINDOW = 20
#: Least bits per character in a window, by the class of the whole candidate.
THRESHOLDS = {"hex": 2.9, "alphanumeric": 3.6, "base64": 3.8}
UUID = re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}")
PLACEHOLDER = re.compile(r"(?i)example|placeholder|dummy|sample|changeme|xxxx|your[_-]|1234567890|abcdefgh")
SLUG = re.compile(r"[a-z0-9]{1,12}([-_/][a-z0-9]{1,12})+")  # slugs and paths
PART_OF_RUN = re.compile(r"[A-Za-z0-9]+")
JOINTS = "+/_=-"
#: c * log2(c), for the counts of a window.
PART = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 1)]


def kind_of(candidate: str) -> str | None:
    """The character class of a candidate; None for plain words and plain numbers."""
    digits = any(c.isdigit() for c in candidate)
    letters = any(c.isalpha() for c in candidate)
    if not (digits and letters):
        return None
    if all(c in "0123456789abcdefABCDEF" for c in candidate):
        return "hex"
    return "alphanumeric" if candidate.isalnum() else "base64"


def entropies(run: str, window: int = WINDOW) -> list[float]:
    """Shannon entropy of each window, by incremental counts."""
    counts: dict[str, int] = {}
    total, out, full = 0.0, [], math.log2(window)
    for i, c in enumerate(run):
        if i >= window:
            gone = run[i - window]
            n = counts[gone]
            counts[gone] = n - 1
            total += PART[n - 1] - PART[n]
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += PART[n + 1] - PART[n]
        if i >= window - 1:
            out.append(full - total / window)
    return out


def hot_stretches(run: str, least: float) -> list[tuple[int, int, float]]:
    """Merged windows at or above the threshold, as (start, end, most bits)."""
    out: list[tuple[int, int, float]] = []
    for i, bits in enumerate(entropies(run)):
        if bits >= least:
            if out and i <= out[-1][1]:
                out[-1] = out[-1][0], i + WINDOW, max(bits, out[-1][2])
            else:
                out.append((i, i + WINDOW, bits))
    return out


def pieces(run: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What of a run is left, as (start, end), without the spans taken, UUIDs, and parts that hold a placeholder.

    One joint next to what was taken out goes with it.
    """
    out = taken + [m.span() for m in UUID.finditer(run)]
    if PLACEHOLDER.search(run):
        out += [m.span() for m in PART_OF_RUN.finditer(run) if PLACEHOLDER.search(run, m.start(), m.end() + 1)]
    left, at = [], 0
    for start, end in sorted(out):
        if start > at:
            left.append((at, start - (run[start - 1] in JOINTS)))
        if end > at:
            at = end + (run[end : end + 1] in JOINTS and end < len(run))
    return [*left, (at, len(run))]


def bits_of(text: str) -> float:
    n = len(text)
    return -sum(k / n * math.log2(k / n) for k in (text.count(c) for c in set(text)))


def find_secrets(text: str) -> list[tuple[str, int, int, float]]:
    """All spans of a text by start, then kind; the score is the entropy in bits per character."""
    base: list[tuple[str, int, int, float]] = []
    lowered = text.lower()
    if any(w in lowered for w in ASSIGN_WORDS):
        base += [("assign", *m.span(), bits_of(m[2])) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        base += [("access", *m.span(), bits_of(m[0])) for m in ACCESS.finditer(text)]
    added: list[tuple[str, int, int, float]] = []
    known = [[(a, b) for k, a, b, _ in base if k == kind] for kind in ("assign", "access")]
    near = [0, 0]
    for m in CANDIDATE.finditer(text):
        run, at = m[0], m.start()
        kind = kind_of(run)
        base += [("hex", at + h.start(), at + h.end(), bits_of(h[0])) for h in HEX.finditer(run)]
        if not kind:
            continue
        taken = [h.span() for h in HEX.finditer(run)]
        for k, spans in enumerate(known):
            while near[k] < len(spans) and spans[near[k]][1] <= at:
                near[k] += 1
            for a, b in spans[near[k] : near[k] + m.end() - at]:
                if a >= m.end():
                    break
                taken.append((max(a, at) - at, min(b, m.end()) - at))
        for start, end in pieces(run, taken):
            piece = run[start:end]
            if len(piece) >= WINDOW and (kind := kind_of(piece)) and not SLUG.fullmatch(piece):
                added += [("entropy", at + start + a, at + start + b, bits) for a, b, bits in hot_stretches(piece, THRESHOLDS[kind])]
    return sorted(base + added, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans (kind, start, end, score) for every row of ``docs``.

    Starts and ends are code points, ends exclusive; spans are ordered by start, then kind
    (assign, access, hex, entropy).  A null or empty text has no spans; texts of any length are
    read whole.  Repeated rows give repeated results, an empty table none.
    """

    def make():
        def run(ids, texts):
            yield pa.RecordBatch.from_arrays([ids, span_arrays([find_secrets(t) for t in texts])], ["doc_id", "spans"])

        return run

    rows = id_and_text(docs, id_col, text_col)
    return map_texts(rows, make, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, spans {SPANS}")


def redact(text: str, spans: list[tuple]) -> str:
    """The text with each secret span replaced by a marker of its kind."""
    out, at = [], 0
    for kind, start, end, *_ in sorted(spans, key=lambda s: s[1]):
        if end > at:
            out += [text[at : max(at, start)], f"[{kind}]"]
            at = end
    return "".join([*out, text[at:]])


def redact_documents(docs: DataFrame, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """``docs`` with all columns, secrets in the text replaced by markers; a column of sizes follows the text.

    All rows stay, repeated ones too; null and empty texts stay as they are; an empty table gives
    no rows.
    """

    def run(batches):
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            clean = [t and redact(t, find_secrets(t)) for t in texts]
            if clean != texts:
                names = batch.schema.names
                columns = list(batch.columns)
                columns[names.index(text_col)] = pa.array(clean, pa.string())
                if size_col in names:
                    at = names.index(size_col)
                    sizes = [n if a == b else len(b) for a, b, n in zip(texts, clean, columns[at].to_pylist())]
                    columns[at] = pa.array(sizes, batch.schema.field(at).type)
                batch = pa.RecordBatch.from_arrays(columns, names)
            yield batch

    return docs.mapInArrow(run, docs.schema)
