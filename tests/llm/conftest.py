from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty texts, repeated rows, a long text, and columns with clashing names."""
    long = " ".join(f"w{i % 977}" for i in range(40_000))
    rows = [(1, None, None), (2, "", "a"), (3, " \n\t ", "a"), (4, "one", "b"), (5, "One", "b"), (6, "one two three", None), (6, "one two three", None), (7, long, "c"), (8, long + " end", "c"), (9, "Ünï 日本 text, with 12.5% \"quotes\"", "d")]
    return spark.createDataFrame([(*r, "x", 0, 1.0) for r in rows], "doc_id long, text string, source string, id string, band int, score double")
