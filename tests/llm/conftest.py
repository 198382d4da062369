import random

import pytest


@pytest.fixture
def rng():
    return random.Random(11)


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """documents from (doc_id, text, lang, source)."""

    def make(rows, schema=DOCS):
        return spark.createDataFrame([(i, t, lang, src, None if t is None else len(t)) for i, t, lang, src in rows], schema)

    return make


#: rows that every operator must take
ODD = [(1, None, "en", "a"), (2, "", None, "a"), (3, " \n\t ", "en", None), (4, "word", "en", "a"), (4, "word", "en", "a"), (None, "no id here at all", "de", "b"), (5, "é" * 70 + " " + "x" * 5000 + " ünï", None, None), (6, "\x00 nul \x0b vt ***", "en", "b"), (7, "long " * 30_000, "en", "b")]


@pytest.fixture
def odd(spark):
    """Odd rows with extra columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, lang, src, None, "x", 1, 2.0) for i, t, lang, src in ODD], "doc_id long, text string, lang string, source string, n_chars long, key string, size int, score double")


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], DOCS)
