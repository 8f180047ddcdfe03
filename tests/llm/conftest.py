from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, texts, first=0):
    """A documents table of texts, ids ascending."""
    rows = [(first + i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def docs(spark):
    return lambda texts, first=0: table(spark, texts, first)


def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns with clashing names."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [
        (1, "one two three four five six seven eight nine ten", "en", "s", 5),
        (1, "one two three four five six seven eight nine ten", "en", "s", 5),
        (2, None, None, None, None),
        (None, "no id here at all, one two three", "en", "s", 3),
        (None, None, None, None, None),
        (3, "", "", "", 0),
        (4, "   \n\t ", "de", "s", 6),
        (5, long, "en", "s", len(long)),
        (6, "é", "fr", "s", 1),
        (7, "🙂" * 60, "xx", "s", 60),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    from pyspark.sql import functions as F

    names = ("score", "spans", "kept", "n_bytes", "fingerprint", "labels", "n_words", "shard", "k", "t", "b", "length", "start", "id", "text_", "item_id", "n_tokens", "_owner")
    return df.select("*", *(F.lit(i).alias(n) for i, n in enumerate(names)))


@pytest.fixture
def odd_docs(spark):
    return odd(spark)


@pytest.fixture
def none_docs(spark):
    return spark.createDataFrame([], SCHEMA)


TOKENIZERS = pytest.importorskip("public_tokenizers")
