from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, doc string, th long, kept boolean"


def row(doc_id, text, lang="en", source="s0"):
    return (doc_id, text, lang, source, None if text is None else len(text), 0.5, "x", "y", 7, None)


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty and blank texts, repeated rows, one very long text, clashing extra columns."""
    r = random.Random(8)
    words = [" ".join(r.choice(["red", "green", "blue", "Öl", "x1", "###"]) for _ in range(r.randint(1, 90))) for _ in range(12)]
    rows = [row(k, t) for k, t in enumerate(words)]
    rows += [row(20, None), row(21, ""), row(22, " \n\t "), row(None, words[0], None, None), row(23, words[1], "de", None), row(23, words[1], "de", None)]
    rows += [row(24, words[2] + "\n" + words[3], "fr", "s1"), row(25, "long " * 260_000, None, "s2"), row(26, "日本語 \U0001f600 é", "en", "s3"), row(None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
