from __future__ import annotations

import pytest

LONG = "word and other things " * 3000
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, h1 string, key string, shard int, place string, fp long"

#: Nulls in every column, empty and very long texts, ties, repeated rows and columns that clash with the operators' own.
ODD = [
    (1, "The first line here is long enough\nand a second line that is", "en", "a", 10, 0.5, 3, "x", "k", 4, "p", 9),
    (1, "The first line here is long enough\nand a second line that is", "en", "a", 10, 0.5, 3, "x", "k", 4, "p", 9),
    (2, "the first line here is lung enough\n\nother words altogether in this one", "en", "b", None, None, None, None, None, None, None, None),
    (3, None, None, None, None, None, None, None, None, None, None, None),
    (4, "", "de", "a", 0, 0.1, 1, "y", "k", 2, "q", 1),
    (None, "no id at all but some words", "fr", "c", 5, 0.2, 2, "z", "k", 3, "r", 2),
    (5, LONG, "en", None, 60000, 0.3, 7, "w", "k", 1, "s", 3),
    (6, LONG, "en", "c", 60000, 0.3, 7, "w", "k", 1, "s", 3),
    (7, " \t\n\x0b\x0c\r ", "es", "d", 7, 0.0, 0, "v", "k", 0, "t", 4),
    (8, "日本語 テキスト 😀 é ñ", "ja", "\U0001f600", 15, 0.0, 0, "v", "k", 0, "t", 4),
    (9, "x" * 900, "en", "é", 900, 0.0, 0, "v", "k", 0, "t", 4),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, (k // 2) % 2) for k in range(1, 10)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
