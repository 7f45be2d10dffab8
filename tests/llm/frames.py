"""Frames with everything that may be wrong with documents."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, tokens string, size int"


def odd_documents(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns named like results."""
    words = [f"w{i % 700}" for i in range(30_000)]
    rows = [
        (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "a", 10),
        (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "a", 10),
        (2, "Alpha beta gamma delta epsilon zeta eta theta", "en", "a", 10),
        (3, None, "en", "a", None),
        (4, "", "de", None, 0),
        (5, " \n\t ", None, "b", 3),
        (6, " ".join(words), "en", "b", 1),
        (7, "x" * 100_000, "en", "b", 1),
        (None, "an id is missing here for sure", "en", "c", 1),
        (8, "short", None, None, None),
        (9, "ünï \u2581 \U0001f600 漢字\u00a0ß", "de", "c", 1),
    ]
    return spark.createDataFrame([(*r, "s", "t", 1) for r in rows], SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
