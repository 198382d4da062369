import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from stratasieve.llm import bytetext as bt

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbé€ \n\t\x0b0-_", max_size=30)), max_size=12)


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(1, 40))
def test_words_equal_regular_expressions(texts, most):
    got = [[] for _ in texts]
    alnum = [[] for _ in texts]
    for i, j, t in bt.slices(pa.array(texts, pa.string()), most):
        for out, kind, lower in ((got, bt.NOT_SPACE, False), (alnum, bt.ALNUM, True)):
            w = t.words(kind, lower)
            for d, a, b in zip(w.doc, w.start, w.end):
                out[i + d].append(w.data[a:b].tobytes().decode())
    az = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", x or "") for x in texts]
    assert alnum == [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (x or "").translate(az)) for x in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab ", max_size=20), max_size=6), st.integers(1, 4))
def test_grams_hash_equal_runs_equally(texts, k):
    t = bt.one(texts)
    w = t.words(bt.NOT_SPACE, False)
    at, g = w.grams(k)
    words = [x.split() for x in texts]
    want = [(d, tuple(ws[i : i + k])) for d, ws in enumerate(words) for i in range(len(ws) - k + 1)]
    assert [int(w.doc[a]) for a in at] == [d for d, _ in want]
    for x in range(len(want)):
        for y in range(len(want)):
            assert (g[x] == g[y]) == (want[x][1] == want[y][1])


def test_first_of_equal():
    n, first = bt.first_of_equal(np.array([0, 0, 0, 1]), np.array([5, 6, 5, 5], np.uint64))
    assert n.tolist() == [2, 1, 2, 1] and first.tolist() == [True, True, False, True]


def test_slices_of_a_sliced_array():
    a = pa.array(["xx", "a b", None, "c"]).slice(1)
    assert [(i, j, t.data.tobytes()) for i, j, t in bt.slices(a, 1)] == [(0, 1, b"a b"), (1, 3, b"c")]
