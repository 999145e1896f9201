"""Rows that every operator must bear: nulls, empty and very long texts, repeated rows, clashing column names."""

from __future__ import annotations

LONG = "lorem ipsum dolor sit amet " * 40_000
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, rank int, comp long, n long, row long, term string"


def documents(spark, more=(), empty=False):
    rows = [] if empty else [
        (1, "The quick brown fox jumps over the lazy dog near the river bank today.", "en", "a", 70),
        (2, None, "en", None, None),
        (3, "", None, "a", 0),
        (4, " \t\n ", "en", "b", 4),
        (5, "1234 !!! 5678", None, None, 13),
        (6, LONG, "en", "b", len(LONG)),
        (6, LONG, "en", "b", len(LONG)),
        (None, "a text without any id, the same words as others have", None, "c", 5),
        (None, None, None, None, None),
        (7, "The quick brown fox jumps over the lazy dog near the river bank today.", "en", "a", 70),
        (8, "x" * 200_000, None, "a", 200_000),
    ]
    rows += [(i, t, "en", "m", len(t)) for i, t in more]
    return spark.createDataFrame([(*r, "k", 1, 2, 3, 4, "t") for r in rows], DOCS).repartition(3)
