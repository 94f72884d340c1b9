import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHES = ["id", "score", "predicted", "size", "times", "token", "fp", "th", "sig", "n", "g", "side", "node", "component", "host", "path", "rule", "ids", "row", "turns", "e", "_id", "_times"]


@pytest.fixture(scope="session")
def hard_docs():
    """Nulls, empty and very long texts, texts without words, repeated rows, ties."""
    base = "the quick brown fox jumps over the lazy dog and runs away from the old house by the river at night"
    words = " ".join(f"w{k}" for k in range(9000))
    texts = [
        "", None, base, base, base.upper() + "!", base + " today", base.replace("river", "lake"), "one two", "one two", "!!! ???", " \n\t ", words, words + " end", "é" * 9000, "ab" * 7000 + "'s<|endoftext|>x",
        "日本語 テキスト", "a\u0301 <|startoftext|> \u00a0 b", "Word, word. WORD! it's",
    ]
    rows = [(k, t, "en", None if k % 5 == 0 else f"s{k % 3}", None if t is None else len(t)) for k, t in enumerate(texts)]
    return [*rows, rows[2], (None, base + " then", None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="session")
def frame(spark):
    """A frame with the given rows and, beside them, columns whose names the operators use themselves."""

    def make(rows, schema=SCHEMA, clash=True):
        df = spark.createDataFrame(rows, schema)
        return df.select("*", *(F.lit("x").alias(c) for c in CLASHES if c not in df.columns)) if clash else df

    return make
