"""Quotes whose lines are not those of the original."""

import pytest

from stratasieve.llm import quote_links as ql

LONG = "The quick brown fox jumps over the lazy dog while the cat sleeps on the old wooden chair near the window."
TALK = [
    (1, 0, LONG),
    (1, 1, "> The quick brown fox jumps over\n> the lazy dog while the cat sleeps on the\n> old wooden chair near the window.\nrewrapped"),
    (1, 2, "> > The quick brown fox jumps over the lazy\n> > dog while the cat sleeps on\n> rewrapped\ntwo levels"),
    (1, 3, "> lazy dog while the cat\npart"),
    (1, 4, "First line\nand second line"),
    (1, 5, "> First line and second line\njoined"),
    (1, 6, "> quite other words that nobody has said in this talk\n> and more of them\nnothing"),
    (1, 7, "> dog while the cat sleeps on\n> words that nobody has said\nmixed"),
    (2, 0, "> The quick brown fox jumps over the lazy dog\nanother conversation"),
    (3, 0, "yes no"),
    (3, 1, "> yes\n> no\nbroken"),
    (3, 2, "> yes\n\none word of two"),
    (4, 1, "> later words are no original of this\nearly"),
    (4, 2, "Later words are no original of this one"),
]


@pytest.fixture(scope="module")
def built(spark):
    df = spark.createDataFrame([(c, t, "user", x) for c, t, x in TALK], "conv_id long, turn long, role string, text string")
    return {(x["conv_id"], x["turn"]): x for x in ql.build_conversations(df).collect()}


def test_passages_link(built):
    g = lambda c, t: tuple(built[c, t][k] for k in ("parent", "thread", "depth", "links", "n_quoted"))
    assert g(1, 1) == (0, 0, 1, 3, 3)
    assert g(1, 2) == (1, 0, 2, 3, 3)
    assert g(1, 3) == (0, 0, 1, 1, 1) and g(1, 5) == (4, 4, 1, 1, 1)
    assert g(1, 6) == (None, 6, 0, 0, 2) and g(1, 7)[0] == 0 and g(1, 7)[3] == 1
    assert g(2, 0)[0] is None and g(3, 1) == (0, 0, 1, 2, 2) and g(3, 2)[0] is None and g(4, 1)[0] is None
    assert len(built) == len(TALK)
