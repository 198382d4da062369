import os
import re
from collections import Counter

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratasieve.llm import bytetext as bt
from stratasieve.llm import mixing, quality_rules

SF = "/root/testdata/sf0.001"


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(zip(words, words[1:], words[2:]))
    hit = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)]


def test_base_counts_against_brute_force(rng):
    texts = ["", "a", "a b a b a", "x y z x y z\nx y z\n\nx y z", "é** ü|<\n \n \né** ü|<", "\n\n", "a\n a\na"]
    texts += ["".join(rng.choice(["a", "b", " ", " ", "\n", "#", "é"]) for _ in range(60)) for _ in range(60)]
    got = list(zip(*[x.tolist() for x in quality_rules.base_counts(bt.one(texts))]))
    assert [list(x) for x in got] == [counts(x) for x in texts]


def test_rules_on_odd_rows(odd, none):
    out = quality_rules.quality_rules(odd)
    got = {x["doc_id"]: x for x in out.collect()}
    assert out.count() == 9 and got[1]["n_words"] == 0 and got[1]["base_failed"] and not got[1]["kept"] and got[7]["base_failed"]
    assert quality_rules.quality_rules(none).count() == 0


def test_adaptive_fence_drops_the_outlier_of_its_group(docs, rng):
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    text = lambda n, k: " ".join(word(n) for _ in range(k))
    rows = [(i, text(5, 80), "en", "s") for i in range(120)] + [(500 + i, text(12, 80), "de", "s") for i in range(120)] + [(900, text(14, 80), "en", "s"), (901, text(12, 80), "de", "t")]
    kept = {x["doc_id"]: x["kept"] for x in quality_rules.quality_rules(docs(rows)).collect()}
    assert not kept[900] and kept[901] and sum(kept.values()) == 241


def water(sizes, weights=(5, 2, 1), most=3):
    """Targets by resharing until no source is above its stop."""
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: most * sizes[s] for s in over}


def test_targets_equal_resharing(spark, docs, rng):
    rows = [(i, "w " * rng.randrange(1, 40 if i % 7 else 400), "en", rng.choice(["a", "b", "c", "d", "Z", None])) for i in range(300)]
    df = docs(rows)
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len(t.split())
    got = {x["source"]: x["target"] for x in mixing.targets(mixing.sizes(df)).collect()}
    want = water(dict(sizes))
    assert got == {k: pytest.approx(v) for k, v in want.items()}
    out = mixing.pareto_mix(df).toPandas()
    assert (out["copies"] <= 3).all() and len(out) == 300
    taken = (out["copies"] * out["size"]).groupby(out["source"].fillna("null")).sum()
    biggest = out["size"].groupby(out["source"].fillna("null")).max()
    for s, v in want.items():
        assert abs(taken[s or "null"] - v) <= biggest[s or "null"]
    again = mixing.pareto_mix(df.repartition(7)).toPandas()
    assert out.sort_values("doc_id").reset_index(drop=True).equals(again.sort_values("doc_id").reset_index(drop=True))


def test_mix_on_odd_rows(odd, none):
    out = mixing.pareto_mix(odd)
    assert out.count() == 9 and out.where("copies < 0 or copies > 3").count() == 0 and mixing.pareto_mix(none).count() == 0


def test_mix_keeps_other_columns(odd):
    df = odd.selectExpr("*", "1 as target", "2 as whole", "3 as lam", "4 as q")
    out = mixing.copies(df)
    assert out.columns == [*[c for c in df.columns if c != "target"], "source_size", "target", "copies"] and out.count() == 9


def test_rows_that_share_an_id_are_drawn_alone(docs, rng):
    """Null ids, one id on many texts, and equal rows: the source still comes near its target."""
    texts = ["w " * rng.randrange(20, 40) for _ in range(60)]
    rows = [(None, t, "en", "a") for t in texts] + [(7, t, "en", "b") for t in texts] + [(8, "equal row " * 15, "en", "c")] * 60 + [(9, "big " * 3000, "en", "d")]
    df = docs(rows)
    for d in (df, df.repartition(5)):
        out = mixing.pareto_mix(d).toPandas()
        for _, g in out.groupby("source"):
            if g["source"].iloc[0] != "d":
                assert abs((g["copies"] * g["size"]).sum() - g["target"].iloc[0]) <= g["size"].max()
        full = mixing.copies(d).toPandas()
        assert sorted(full["copies"]) == sorted(out["copies"])
    equal = out[out["source"] == "c"]["copies"]
    assert equal.max() - equal.min() <= 1


def test_longer_documents_are_likelier(docs, rng):
    rows = [(i, "w " * (4 if i % 2 else 900), "en", "a" if i % 50 else "b") for i in range(600)]
    out = mixing.pareto_mix(docs(rows)).toPandas()
    a = out[out["source"] == "a"]
    few, many = a[a["size"] == 4]["copies"].mean(), a[a["size"] == 900]["copies"].mean()
    assert 0 < few < 0.9 * many


def test_certain_copies_and_empty_sources(docs):
    out = {x["doc_id"]: x for x in mixing.pareto_mix(docs([(1, "a b", "en", "a"), (2, "", "en", "b"), (3, "c " * 100, "en", "c")])).collect()}
    assert out[1]["target"] == 6.0 and out[1]["copies"] == 3 and out[2]["target"] == 0.0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("module,name", [(quality_rules, "op9_quality_rules"), (mixing, "op4_pareto_mix")])
def test_sql(spark, module, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    frame = lambda d: d[sorted(d.columns)].sort_values("doc_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(frame(module.QUERIES[name](spark, SF).toPandas()), frame(con.sql(module.SQL[name]).df()), check_dtype=False)
