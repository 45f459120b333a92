from __future__ import annotations

import pytest

ODD = [
    (1, None, "en", "a", 0),
    (2, "", None, "a", 0),
    (3, " \n\t ", "en", None, None),
    (4, "Plain words, and a few more of them.", "en", "a", 1),
    (4, "Plain words, and a few more of them.", "en", "a", 1),
    (5, "x" * 30_000, "en", "a", 1),
    (6, "日本語 テキスト 😀 <s> <|endoftext|> é\x00", "ja", "b", 1),
    (7, "word " * 4_000, "en", "b", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and extra columns named like outputs."""
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(ODD, SCHEMA)
    return rows.withColumns({n: F.lit(0) for n in ("score", "spans", "ids", "fp", "key", "n_tokens", "component_id", "start")})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
