"""mmCIF structure files as rows, plain or gzipped, one task per file.

Errors of a file become rows with ``error`` set, so one bad file does not stop the others.
"""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ITEM = re.compile(r"'((?:[^']|'(?=\S))*)'(?=\s|$)|\"((?:[^\"]|\"(?=\S))*)\"(?=\s|$)|(\S+)")
ROWS = "file string, block string, category string, ordinal int, fields map<string,string>, error string"


def tokens(text: str) -> Iterator[tuple[str, bool]]:
    """(value, bare) of a file, in order; comments are left out, text between lines that begin with ; is one value."""
    lines = iter(text.splitlines())
    for line in lines:
        if line.startswith(";"):
            held = [line[1:]]
            for more in lines:
                if more.startswith(";"):
                    break
                held.append(more)
            yield "\n".join(held).strip(), False
            continue
        for m in ITEM.finditer(line):
            if m[3] is None:
                yield m[1] if m[1] is not None else m[2], False
            elif m[3].startswith("#"):
                break
            else:
                yield m[3], True


def parse(text: str, wanted: frozenset[str] | None = None) -> Iterator[tuple[str, str, int, dict[str, str]]]:
    """(block, category, ordinal, fields) of every loop row and of each category of single items.

    A row may wrap over lines; unquoted ? and . are missing.  A category that a block repeats gets
    the suffix _2, _3 and so on.  With ``wanted`` only these categories (without suffix) become
    rows; the others are passed over as they are read.
    """
    block, singles, seen = "", {}, {}
    found = iter([*tokens(text), ("data_", True)])
    value = next(found)

    def named(category):
        seen[category] = seen.get(category, 0) + 1
        return category if seen[category] == 1 else f"{category}_{seen[category]}"

    def mark(t):
        return t[1] and (t[0].startswith("_") or t[0] == "loop_" or t[0].startswith("data_"))

    while True:
        word, bare = value
        if bare and word.startswith("data_"):
            for category, fields in singles.items():
                yield block, named(category), 0, fields
            singles, seen, block = {}, {}, word[5:]
            if (value := next(found, None)) is None:
                return
        elif bare and word == "loop_":
            names, values = [], []
            while (value := next(found))[1] and value[0].startswith("_"):
                names.append(value[0][1:])
            if names and wanted is not None and names[0].partition(".")[0] not in wanted:
                while not mark(value):
                    value = next(found)
                continue
            while not mark(value):
                values.append(None if value[1] and value[0] in ("?", ".") else value[0])
                value = next(found)
            category = named(names[0].partition(".")[0]) if names else ""
            for ordinal in range(len(values) // len(names) if names else 0):
                row = values[ordinal * len(names) : (ordinal + 1) * len(names)]
                yield block, category, ordinal, {n.partition(".")[2]: v for n, v in zip(names, row) if v is not None}
        elif bare and word.startswith("_"):
            category, _, item = word[1:].partition(".")
            value = next(found)
            if not mark(value):
                if not (value[1] and value[0] in ("?", ".")) and (wanted is None or category in wanted):
                    singles.setdefault(category, {})[item] = value[0]
                value = next(found)
        else:
            value = next(found)


def read_mmcif(spark: SparkSession, pattern: str, categories: Iterable[str] | None = None) -> DataFrame:
    """file, block, category, ordinal, fields, error of all files that match; of the categories named, or of all.

    A category that is not asked for is never made into rows, so reading the few lines of
    ``struct`` from many files does not build their atoms.  Errors come whatever is asked for.
    """
    wanted = None if categories is None else frozenset(categories)

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                name = path.rpartition("/")[2]
                try:
                    raw = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
                    rows = [(name, *r, None) for r in parse(raw.decode("utf-8"), wanted)]
                except Exception as e:  # a broken file is a row, not a failure
                    rows = [(name, None, None, None, None, f"{type(e).__name__}: {e}")]
                for at in range(0, len(rows), 10_000):
                    part = list(zip(*rows[at : at + 10_000]))
                    kinds = pa.string(), pa.string(), pa.string(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.string()
                    columns = [pa.array([list(v.items()) if isinstance(v, dict) else v for v in c], t) for c, t in zip(part, kinds)]
                    yield pa.RecordBatch.from_arrays(columns, ["file", "block", "category", "ordinal", "fields", "error"])

    return spark.read.format("binaryFile").load(pattern).select("path", "content").mapInArrow(run, ROWS)


def atoms(rows: DataFrame) -> DataFrame:
    """Atoms with coordinates; rows whose coordinates cannot be read are dropped."""
    f = lambda name: F.try_element_at("fields", F.lit(name))
    number = lambda name, kind: f(name).try_cast(kind)
    out = rows.where(F.col("category") == "atom_site").select(
        "file",
        "ordinal",
        f("group_PDB").alias("grp"),
        f("type_symbol").alias("element"),
        *[number(f"Cartn_{a}", "double").alias(a) for a in "xyz"],
        number("label_seq_id", "int").alias("residue_num"),
        F.coalesce(number("auth_seq_id", "int"), number("label_seq_id", "int")).alias("auth_num"),
        f("label_comp_id").alias("residue_name"),
        f("label_asym_id").alias("chain"),
    )
    return out.where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")


#: Target of a structure file, by the start of its name.
TARGETS = {"1iv0": "EGFR", "3vhe": "VEGF_VEGFR", "3inm": "IDH1_IDH2"}


def with_targets(rows: DataFrame, targets: dict[str, str] = TARGETS) -> DataFrame:
    """``rows`` with the target that the file's name stands for, else the name without its endings."""
    stem = F.regexp_replace("file", r"(\.cif|\.mmcif)?(\.gz)?$", "")
    known = F.create_map(*[F.lit(x) for pair in targets.items() for x in pair])
    return rows.withColumn("target", F.coalesce(F.try_element_at(known, F.lower(stem)), stem))
