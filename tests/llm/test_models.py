"""Language ID and the quality classifier: exact parts against brute force, the rest by held-out accuracy."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratasieve.llm import language_id as lid
from stratasieve.llm import quality_classifier as qc

SF = "/root/testdata/sf0.001"
VOCAB = ["▁", "▁a", "a", "b", "ab", "▁ab", "ba", "é"]


def brute(word, p):
    """Sum over all segmentations of ▁word."""
    text = "▁" + word

    def rest(i):
        if i == len(text):
            return 1.0
        out = 0.0
        for k in range(1, min(lid.MAX_PIECE, len(text) - i) + 1):
            piece = text[i : i + k]
            q = p.get(piece, lid.UNKNOWN if k == 1 else 0.0)
            if q:
                out += q * rest(i + k)
        return out

    return math.log(rest(0))


def test_forward_sums_all_segmentations():
    rng = np.random.default_rng(3)
    p = rng.random((len(VOCAB), 2))
    lookup = lid.Lookup(VOCAB)
    words = ["a", "ab", "abab", "zé", "baabba", "b" * 9, "xyz"]
    got = lid.Lattice(lookup, words).log_likelihood(p)
    for i, w in enumerate(words):
        for lang in range(2):
            want = brute(w, dict(zip(VOCAB, p[:, lang])))
            assert got[i, lang] == pytest.approx(want) and lid.long_word(lookup, w, p)[lang] == pytest.approx(want)


def test_expected_counts_sum_to_segment_counts():
    lookup, p = lid.Lookup(VOCAB), np.full((len(VOCAB), 1), 0.1)
    x = lid.Lattice(lookup, ["ab"])
    e = x.expected(p, np.ones((1, 1)))[:, 0]
    # every segmentation covers the three characters
    assert sum(e[i] * len(v) for i, v in enumerate(VOCAB)) == pytest.approx(3.0)


def test_long_words_do_not_underflow():
    lookup, p = lid.Lookup(VOCAB), np.full((len(VOCAB), 1), 1e-4)
    assert np.isfinite(lid.long_word(lookup, "ab" * 5000, p)).all()
    assert np.isfinite(lid.Lattice(lookup, ["z" * lid.LONG]).log_likelihood(p)).all()


def test_odd_rows(odd, docs, none):
    model = lid.fit(odd)
    got = {(x["doc_id"], x["lang_pred"]) for x in lid.identify(odd, model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und")} <= got and all(x in ("en", "de", "und") for _, x in got)
    assert lid.identify(odd, model).count() == 9 and lid.identify(none, model).count() == 0
    empty = lid.fit(none)
    assert {x["lang_pred"] for x in lid.identify(odd, empty).collect()} == {"und"}


def test_learns_languages(docs):
    en, de = "the house is on the hill and the road", "das haus ist auf dem berg und die straße"
    model = lid.fit(docs([(i, en, "en", "s") for i in range(5)] + [(9 + i, de, "de", "s") for i in range(5)]))
    got = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in lid.identify(docs([(1, "The HILL and house", None, None), (2, "Die Straße auf dem Berg", None, None)]), model).collect()}
    assert got[1][0] == "en" and got[2][0] == "de" and all(0 <= s <= 1 for _, s in got.values())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out_accuracy(spark):
    d = SF.replace("0.001", "0.01")
    r = lid.op1_language_id(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    assert r.where("lang = lang_pred").count() >= 0.97 * r.count()
    q = qc.op3_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert ((q["predicted"] == q["quality"]).mean()) > 0.95 and q["score"].between(0, 1).all()


def test_compiled_rules_equal_the_model(spark):
    rng = np.random.default_rng(1)
    x = rng.random((400, len(qc.STATS))) * 5
    y = ((x[:, 2] > 2) & (x[:, 5] < 4)).astype(float)
    m = qc.Model(x, y)
    assert m.rules and len(m.rules) < 200
    df = spark.createDataFrame([[float(v) for v in row] for row in x[:50]], ", ".join(f"{s} double" for s in qc.STATS))
    got = [r["s"] for r in df.select(m.column().alias("s")).collect()]
    assert got == pytest.approx(m.score(x[:50]).tolist())
    assert ((m.score(x) > 0.5) == (y > 0.5)).mean() > 0.95


def test_lasso_is_sparse():
    rng = np.random.default_rng(2)
    r = (rng.random((500, 20)) > 0.5).astype(float)
    y = (r[:, 3] > 0).astype(float)
    _, w = qc.lasso(r, y, 0.02)
    assert np.argmax(np.abs(w)) == 3 and (np.abs(w) < 1e-9).sum() >= 10


def test_classifier_on_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1, 0), (7, 0, 0), (None, 1, 0), (5, None, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    got = qc.classify(odd, labels)
    assert got.count() == 9 and got.where("score is null or score < 0 or score > 1").count() == 0
    assert qc.keep_good(odd, labels).columns == odd.columns
    no = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert qc.classify(odd, no).where("abs(score - 0.5) < 1e-9").count() == 9 and qc.classify(none, no).count() == 0
    assert qc.keep_good(odd, no).count() == 9


def test_statistics_are_ratios():
    from stratasieve.llm import bytetext as bt

    x = dict(zip(qc.STATS, qc.statistics(bt.one(["HE! HE! x|y 12\nab ab", ""]))[0]))
    assert x["words"] == pytest.approx(math.log2(7)) and x["bangs"] == pytest.approx(2 / 6) and x["echoes"] == pytest.approx(2 / 6) and x["upper"] == pytest.approx(4 / 10)
    assert not qc.statistics(bt.one([""]))[0][:13].any()
