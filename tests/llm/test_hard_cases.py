"""Cases that have gone wrong, or would with weaker hashes, ties or counts."""

import random
import resource

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratasieve.llm import bytetext as bt
from stratasieve.llm import common
from stratasieve.llm import decontaminate as dec
from stratasieve.llm import language_id as lid
from stratasieve.llm import mixing
from stratasieve.llm import near_dedup as nd
from stratasieve.llm import quality_classifier as qc
from stratasieve.llm import quality_rules
from stratasieve.llm import quote_links as ql
from stratasieve.llm import suffix_dedup as sd
from test_duplicates import brute_components, brute_repeats, edited


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(k).count("1") % 2 else a for k in range(n))


PAIRS = [(thue_morse(n), thue_morse(n, "b", "a")) for n in (8, 64, 2048, 4096)]


@pytest.mark.parametrize("x,y", PAIRS)
def test_words_that_collide_under_every_polynomial(x, y):
    w = bt.one([x, y, " ".join(x), " ".join(y)]).words(bt.NOT_SPACE, True)
    assert w.hash[0] != w.hash[1]
    runs = w.runs(w.first[2:4], w.first[3:5])
    assert runs[0] != runs[1]


def test_operators_tell_such_words_apart(spark, docs):
    rows = [(2 * k + j, t, "en", "s") for k, (x, y) in enumerate(PAIRS) for j, t in enumerate((x, y))]
    assert all(r["kept"] for r in nd.near_duplicates(docs(rows)).collect())
    run = lambda x, k: " ".join([f"p{i}" for i in range(30)] + [x] + [f"q{i}" for i in range(30)])
    passages = [(2 * k + j, run(t, k), "en", "s") for k, pair in enumerate(PAIRS) for j, t in enumerate(pair)]
    got = {r["doc_id"]: r["n_repeated"] for r in sd.repeated_passages(docs(passages)).collect()}
    want = brute_repeats(passages)
    assert got == {i: len(want.get((i, t), (set(), set()))[0]) for i, t, *_ in passages} and not any(got.values())
    words = [(2 * k + j, " ".join(t[:64]), "en", "s") for k, pair in enumerate(PAIRS[1:]) for j, t in enumerate(pair)]
    got = {r["doc_id"]: r["n_repeated"] for r in sd.repeated_passages(docs(words)).collect()}
    want = brute_repeats(words)
    assert got == {i: len(want.get((i, t), (set(), set()))[0]) for i, t, *_ in words}
    x, y = PAIRS[2]
    bench = spark.createDataFrame([(1, f"one two {x} four five")], "item_id long, text string")
    hits = {r["doc_id"]: r["n_hit"] for r in dec.decontaminate(docs([(1, f"a one two {x} four five b", "en", "s"), (2, f"a one two {y} four five b", "en", "s")]), bench).collect()}
    assert hits == {1: 5, 2: 0}
    counts = quality_rules.base_counts(bt.one([f"{x}\n{y}\n{x}", f"a b {x} a b {y}"]))
    assert counts[3].tolist() == [1, 0] and counts[4].tolist() == [0, 0]


def test_exact_codes_are_equal_only_for_equal_words():
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["aa", "b", "Cc", "é"]) for _ in range(rng.randrange(9))) for _ in range(40)]
    t = bt.one(texts)
    doc, code = t.words(bt.NOT_SPACE, True, False).exact_runs(3)
    words = [x.lower().split() for x in texts]
    want = [(d, tuple(w[i : i + 3])) for d, w in enumerate(words) if len(w) >= 3 for i in range(len(w) - 2)] + [(d, tuple(w)) for d, w in enumerate(words) if 0 < len(w) < 3]
    assert doc.tolist() == [d for d, _ in want]
    names = {}
    for c, (_, g) in zip(code.tolist(), want):
        assert names.setdefault(g, c) == c
    assert len(set(names.values())) == len(names)


def test_memory_of_a_long_text():
    """Some 25 bytes for each byte of a text of short words, 5-grams included."""
    text = pa.array(["word " * 2_000_000], pa.large_string())
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    ((_, _, t),) = bt.slices(text)
    at, g = t.words(bt.NOT_SPACE, True).grams(5)
    assert len(g) == 1_999_996 and len(np.unique(g)) == 1
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 30 * 10_000


def test_words_over_the_edge_of_a_chunk(monkeypatch):
    texts = ["abc def", "gh", "", " x yz "]
    whole = bt.one(texts).words(bt.NOT_SPACE, True)
    for n in (1, 2, 3, 5):
        monkeypatch.setattr(bt, "CHUNK", n)
        w = bt.one(texts).words(bt.NOT_SPACE, True)
        assert w.start.tolist() == whole.start.tolist() and w.end.tolist() == whole.end.tolist()


def test_the_filter_keeps_every_wanted_row(spark):
    df = spark.range(1000).selectExpr("id as doc_id", "1 as `word of the filter 2`")
    wanted = spark.range(0, 1000, 7).select(F.xxhash64("id").alias("key"))
    some, rest = common.near(df, F.xxhash64("doc_id"), wanted)
    a, b = {x[0] for x in some.select("doc_id").collect()}, {x[0] for x in rest.select("doc_id").collect()}
    assert set(range(0, 1000, 7)) <= a and not a & b and len(a | b) == 1000 and len(a) < 160 and some.columns == df.columns
    none, every = common.near(df, F.xxhash64("doc_id"), wanted.limit(0))
    assert none.count() == 0 and every.count() == 1000


def test_one_plan_at_every_size(docs, monkeypatch):
    """With a filter so small that every text passes it, results are the same."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(120)]
    rows = [(k, edited(rng, base, k % 3) + (" tail" * (k % 2)), "en", "s") for k in range(12)] + [(50 + k, f"only {k}", "en", "s") for k in range(9)]
    monkeypatch.setattr(common, "FILTER_BITS", 64)
    comp = brute_components(rows)
    assert sorted(x["doc_id"] for x in nd.drop_near_duplicates(docs(rows)).collect()) == sorted(i for i, c in comp.items() if i == c)
    gone = brute_repeats(rows)
    left = {i: [w for k, w in enumerate(t.split()) if k not in gone.get((i, t), (set(), set()))[1]] for i, t, *_ in rows}
    assert {x["doc_id"]: x["text"].split() for x in sd.cut_repeats(docs(rows)).collect()} == {i: w for i, w in left.items() if w}


@pytest.mark.parametrize("dense", [0])
def test_dense_buckets_and_small_blocks(docs, monkeypatch, dense):
    monkeypatch.setattr(nd, "BLOCK", 8)
    monkeypatch.setattr(nd, "TEXT_BLOCK", 900)
    monkeypatch.setattr(nd, "DENSE", dense)
    rng = random.Random(dense)
    base = [f"v{k}" for k in range(150)]
    rows = [(k, edited(rng, base, 3), "en", "s") for k in range(50)]
    assert {x["doc_id"]: x["component_id"] for x in nd.near_duplicates(docs(rows)).collect()} == brute_components(rows)


def test_one_id_on_two_texts(docs):
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows = [(5, a, "en", "s"), (5, b, "en", "s"), (3, b, "en", "s"), (9, a + " tail", "en", "s")]
    got = sorted((x["doc_id"], x["component_id"], x["kept"]) for x in nd.near_duplicates(docs(rows)).collect())
    assert got == [(3, 3, True), (5, 3, False), (5, 5, True), (9, 5, False)]
    assert sorted((x["doc_id"], x["text"][0]) for x in nd.drop_near_duplicates(docs(rows)).collect()) == [(3, "b"), (5, "a")]


def test_ids_that_are_no_numbers(spark):
    df = spark.createDataFrame([("a1", "some words here", "en", "s"), ("7", "other words there", "en", "s")], "doc_id string, text string, lang string, source string")
    bench = spark.createDataFrame([("x", "words here")], "item_id string, text string")
    labels = spark.createDataFrame([("a1", 1), ("7", 0)], "doc_id string, quality int")
    assert sd.repeated_passages(df).count() == dec.decontaminate(df, bench).count() == mixing.pareto_mix(df).count() == quality_rules.quality_rules(df).count() == qc.classify(df, labels).count() == 2
    assert nd.drop_near_duplicates(df).count() == sd.cut_repeats(df).count() == 2 and dec.clean(df, bench).count() == 1 and mixing.copies(df).count() == 2
    assert {x["doc_id"] for x in mixing.pareto_mix(df).collect()} == {None, 7}


def test_number_characters_are_no_letters(docs):
    model = lid.fit(docs([(1, "the house", "en", "s"), (2, "das haus", "de", "s")]))
    got = [tuple(x) for x in lid.identify(docs([(1, "½ ² ① Ⅻ 12 _", None, None)]), model).collect()]
    assert got == [(1, "und", 0.0)]
    assert lid.words("x²y Ab½ Straße") == ["x", "y", "ab", "straße"]


def test_the_sample_of_languages_is_bounded(docs, monkeypatch):
    seen = []
    real = lid.Model.__init__
    monkeypatch.setattr(lid.Model, "__init__", lambda self, v, langs, counts, n: (seen.append({x: sum(k for y, _, k in counts if y == x) for x in langs}), real(self, v, langs, counts, n))[1])
    rows = [(None, f"word w{'abcdefghij'[k % 10]}{'abcdefghij'[k // 10 % 10]}{'abcdefghij'[k // 100 % 10]}", "en", "s") for k in range(1000)] + [(None, "gleich gleich", "de", "s")] * 500
    lid.fit(docs(rows), most=100)
    assert seen == [{"en": 200, "de": 2}]


def test_the_sample_of_labels_is_bounded(spark, docs):
    rows = [(k, f"text {k}" * (k % 5), "en", "s") for k in range(200) for _ in range(3)]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(200) for _ in range(4)], "doc_id long, quality int, toxic int")
    lengths = []
    real = qc.Model.__init__
    try:
        qc.Model.__init__ = lambda self, x, y: (lengths.append(len(y)), real(self, x, y))[1]
        qc.fit(docs(rows), labels, most=50)
    finally:
        qc.Model.__init__ = real
    assert lengths == [50]


def test_statistics_against_plain_python():
    rng = random.Random(9)
    texts = ["", "a", "Ab! Ab! x|y; 12.", "long" * 9 + "\n" + "long" * 9] + ["".join(rng.choice("aB1 .,;!?|#\n é") for _ in range(80)) for _ in range(60)]
    for t, got in zip(texts, qc.statistics(bt.one(texts))):
        w = t.split()  # the texts hold no other white space
        raw = t.encode()
        n, lines = max(len(w), 1), [x for x in t.split("\n") if x.strip()]
        low = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in w]
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        rep = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
        up, lo = sum(65 <= c <= 90 for c in raw), sum(97 <= c <= 122 for c in raw)
        chars = sum(map(len, w))
        want = [np.log2(1 + len(w)), chars / n, sum(c in "#*$%&|<>" for c in t) / n, t.count("!") / n, t.count("|") / n, up / max(up + lo, 1), sum(c.isdigit() for c in t) / max(chars, 1), (t.count(".") + t.count("?")) / n, (t.count(",") + t.count(";")) / n, len(rep) / n, sum(a == b for a, b in zip(low, low[1:])) / n, len(set(low)) / n, (len(lines) - len(set(lines))) / (t.count("\n") + 1), (t.count("\n") + 1) / n, sum(len(x.encode()) > 20 for x in w) / n]
        assert got.tolist() == pytest.approx(want)


def test_lasso_meets_its_optimality_conditions():
    rng = np.random.default_rng(3)
    r = (rng.random((300, 12)) > 0.5).astype(float)
    y = ((r[:, 1] + r[:, 4] + rng.random(300)) > 1.4).astype(float)
    b, w = qc.lasso(r, y, 0.01, 5000)
    g = r.T @ (1 / (1 + np.exp(-(b + r @ w))) - y) / len(y)
    for k in range(12):
        assert abs(g[k]) <= 0.01 + 1e-4 if abs(w[k]) < 1e-9 else abs(g[k] + 0.01 * np.sign(w[k])) < 1e-4


def test_trees_against_a_search_of_all_cuts():
    rng = np.random.default_rng(6)
    x = rng.random((60, len(qc.STATS))).round(2)
    y = (x[:, 7] > 0.4).astype(float)
    cuts = [np.unique((np.unique(x[:, k])[1:] + np.unique(x[:, k])[:-1]) / 2) for k in range(x.shape[1])]

    class Order:  # every statistic is looked at
        def permutation(self, n):
            return np.arange(n)[::-1]

    rules = set()
    qc._tree(x, y, cuts, Order(), (), rules)
    chosen = sorted(range(x.shape[1]))[-((x.shape[1] + 1) // 2) :]
    gini = lambda m: m.sum() * y[m].mean() * (1 - y[m].mean()) if m.any() else 0
    best = max(((-gini(x[:, k] <= c) - gini(x[:, k] > c), -k, -c) for k in chosen for c in cuts[k] if min((x[:, k] <= c).sum(), (x[:, k] > c).sum()) >= 5))
    first = {r for r in rules if len(r) == 1}
    assert {(-best[1], True, -best[2]), (-best[1], False, -best[2])} == {r[0] for r in first}


TALK = [(1, 0, "user", "Alpha beta gamma."), (1, 1, "user", "Delta words here."), (1, 2, "user", "> Alpha beta gamma.\nfirst"), (1, 2, "user", "> Delta words here.\nsecond"), (1, 3, "user", "no quote"), (1, 3, "user", "> second\nanswer"), (1, 4, "user", "> first\nlast")]


def test_repeated_turns_are_linked_alone(spark):
    df = spark.createDataFrame(TALK, "conv_id long, turn long, role string, text string")
    got = {x["text"]: (x["parent"], x["thread"], x["depth"], x["links"]) for x in ql.build_conversations(df).collect()}
    assert got["first"] == (0, 0, 1, 1) and got["second"] == (1, 1, 1, 1) and got["no quote"] == (None, 3, 0, 0)
    assert got["answer"] == (2, 1, 2, 1) and got["last"] == (2, 0, 2, 1)
    twice = ql.build_conversations(df.unionByName(df)).collect()
    assert sorted((x["text"], x["links"]) for x in twice) == sorted([(k, v[3]) for k, v in got.items()] * 2)


def test_the_query_returns_replies_in_order(spark, tmp_path):
    spark.createDataFrame(TALK, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    rows = ql.op2_quote_links(spark, str(tmp_path)).collect()
    assert [(x["thread"], x["turn"]) for x in rows] == sorted((x["thread"], x["turn"]) for x in rows)


def test_a_long_message_and_a_tied_original(spark):
    long = " ".join(f"word{k}" for k in range(40_000))
    rows = [(1, 0, "user", long), (1, 0, "bot", "tie line"), (1, 0, "user", "tie line"), (1, 1, "user", "> " + long + "\n> tie line\nok")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = [x for x in ql.build_conversations(df).collect() if x["turn"] == 1]
    assert [(x["parent"], x["links"], x["n_quoted"], x["text"]) for x in got] == [(0, 2, 2, "ok")]
