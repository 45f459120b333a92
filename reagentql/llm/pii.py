"""Personal data: patterns propose, checksums confirm, context words adjust the score."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from reagentql.llm.common import SPANS, id_and_text, map_texts, span_arrays

# The proposed shapes.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN_REST = re.compile(r"(?:\x20?[A-Z0-9]){11,30}")
IBAN_HEAD = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=\x20?[A-Z0-9])")
DIGIT = re.compile(r"[0-9]")
KINDS = ("email", "ip", "card", "phone", "iban")
#: Score of a confirmed span before its surroundings are read, and words that raise it.
START = {"email": 0.8, "ip": 0.5, "card": 0.7, "phone": 0.5, "iban": 0.8}
CONTEXT = {
    "email": ("mail", "contact", "write", "address"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "payment", "mastercard"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "transfer"),
}
LOWERING = ("version", "example", "test", "order", "serial")
REACH = 40


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    rest = 0
    for c in iban[4:] + iban[:4]:
        rest = (rest * (100 if c.isalpha() else 10) + int(c, 36)) % 97
    return rest == 1


def ibans(text: str):
    """From each head the longest run that ends where a group ends and has the checksum; a head in a failed run counts."""
    done = 0
    for head in IBAN_HEAD.finditer(text):
        if head.start() < done or not (rest := IBAN_REST.match(text, head.end())):
            continue
        for end in range(rest.end(), head.end() + 10, -1):
            # A group ends before anything but a letter or digit.
            if text[end - 1] == " " or (end < len(text) and text[end].isascii() and text[end].isalnum()):
                continue
            if 15 <= len(s := text[head.start() : end].replace(" ", "")) <= 34 and mod97(s):
                yield head.start(), end
                done = end
                break


def emails(text: str):
    """Leftmost matches, found from each @ so that long runs cost linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def digits_of(s: str) -> str:
    return "".join([c for c in s if "0" <= c <= "9"])


def find_personal(text: str) -> list[tuple[str, int, int, float]]:
    """All confirmed spans of a text by kind, then start, with their scores."""
    out: list[tuple[str, int, int]] = []
    if "@" in text:
        out += [("email", a, b) for a, b in emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p) < 4 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split("."))):
                out.append(("ip", *m.span()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15]
        out += [("iban", a, b) for a, b in ibans(text)]
    scored = []
    for kind, start, end in out:
        around = f"{text[max(0, start - REACH) : start]} {text[end : end + REACH]}".lower()
        score = START[kind] + 0.2 * any(w in around for w in CONTEXT[kind]) - 0.2 * any(w in around for w in LOWERING)
        scored.append((kind, start, end, round(score, 2)))
    return sorted(scored, key=lambda s: (KINDS.index(s[0]), s[1]))


def scan_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans (kind, start, end, score) for every row of ``docs``.

    Starts and ends are code points, ends exclusive; spans are ordered by kind (email, ip,
    card, phone, iban), then start.  The score of a span starts from its kind's and is raised
    and lowered by words within 40 characters.  A null or empty text has no spans; texts of any
    length are read whole, in time linear in it but for overlong digit groups.  Repeated rows
    give repeated results, an empty table none.
    """

    def make():
        def run(ids, texts):
            yield pa.RecordBatch.from_arrays([ids, span_arrays([find_personal(t) for t in texts])], ["doc_id", "spans"])

        return run

    rows = id_and_text(docs, id_col, text_col)
    return map_texts(rows, make, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, spans {SPANS}")
