"""Language ID with pieces of any length."""

import math

import numpy as np
import pytest
import sentencepiece

from stratasieve.llm import language_id as lid


def test_all_letter_pieces_are_kept():
    path = lid.default_vocabulary()
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    want = {p for p in (sp.id_to_piece(i).lower() for i in range(sp.get_piece_size())) if p == lid.MARK or p.removeprefix(lid.MARK).isalpha()}
    assert set(lid.pieces(path)) == want
    assert lid.Lookup(lid.pieces(path)).longest == max(map(len, want)) == lid.MAX_PIECE


def brute(word, p):
    """Sum over all segmentations of ▁word, pieces of any length."""
    text = lid.MARK + word
    a = [1.0] + [0.0] * len(text)
    for j in range(1, len(text) + 1):
        for i in range(j):
            a[j] += a[i] * p.get(text[i:j], lid.UNKNOWN if j - i == 1 else 0.0)
    return math.log(a[-1])


def test_long_pieces_are_summed():
    vocabulary = ["▁", "▁a", "a", "b", "ab", "ababab", "▁abababab", "babababa", "b" * 20]
    p = np.random.default_rng(5).random((len(vocabulary), 2))
    lookup = lid.Lookup(vocabulary)
    words = ["abababab", "ababababab", "a" + "b" * 21, "babababa", "b" * 45, "ab"]
    got = lid.Lattice(lookup, words).log_likelihood(p)
    for i, w in enumerate(words):
        for lang in range(2):
            want = brute(w, dict(zip(vocabulary, p[:, lang])))
            assert got[i, lang] == pytest.approx(want) and lid.long_word(lookup, w, p)[lang] == pytest.approx(want)


def test_long_pieces_are_fitted():
    vocabulary = ["▁", "a", "b", "▁abababab"]
    x = lid.Lattice(lid.Lookup(vocabulary), ["abababab"])
    e = x.expected(np.full((4, 1), 0.1), np.ones((1, 1)))[:, 0]
    assert e[3] > 0.9 and sum(n * len(v) for n, v in zip(e, vocabulary)) == pytest.approx(9.0)
