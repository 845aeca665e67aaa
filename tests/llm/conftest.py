"""Tables for the edge cases that every operator must define."""

import pytest

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _size long, _key string, taken long, t string, nats double"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, clashing extra columns."""
    long = " ".join(f"word{i % 977} und so weiter {i}" for i in range(4000))
    body = "the quick brown fox jumps over the lazy dog near the quiet river bank at dawn while birds sing softly in the tall trees " * 4
    rows = [
        (1, body, "en", "a"),
        (1, body, "en", "a"),
        (2, body + "tail", "en", "a"),
        (3, None, "en", None),
        (4, "", None, "b"),
        (5, long, "de", "b"),
        (None, long, "de", "b"),
        (6, "é\U0001f600 \t\n x", None, None),
        (7, "...\n\n...", "fr", "c"),
        (8, "one two", "fr", "c"),
    ]
    return spark.createDataFrame([(*r, None, 7, "k", 3, "t", 0.5) for r in rows], DOCS)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
