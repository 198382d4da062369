"""Near-duplicates, repeated passages and decontamination against brute force."""

import hashlib
import math
import os
import re

import duckdb
import pandas as pd
import pytest

from stratasieve.llm import common
from stratasieve.llm import decontaminate as dec
from stratasieve.llm import near_dedup as nd
from stratasieve.llm import suffix_dedup as sd

SF = "/root/testdata/sf0.001"
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def space_words(x):
    return re.findall(r"[^\x20\x09-\x0D]+", x or "")


def shingles(x):
    w = space_words((x or "").translate(AZ))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows, percent=85):
    sets = [(i, shingles(t)) for i, t, *_ in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (i, a) in enumerate(sets):
        for j, b in sets[n + 1 :]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                u, v = find(i), find(j)
                root[max(u, v)] = min(u, v)
    return {i: find(i) for i in root}


def edited(rng, words, n):
    w = list(words)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
    return " ".join(w)


def test_near_duplicates_against_brute_force(docs, rng):
    rows, n = [], 0
    for g in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([8, 40, 120, 200]))]
        for k in range(rng.choice([1, 2, 6, 25])):
            rows.append((n * 7 % 1009, edited(rng, base, rng.choice([0, 0, 1, 1, 2, 3])), "en", "s"))
            n += 1
    rows += [(2000, "Hello World", "en", "s"), (2001, "hello  WORLD", "en", "s"), (2002, "hello", "en", "s"), (2003, None, "en", "s"), (2004, " ", "en", "s")]
    got = {x["doc_id"]: x for x in nd.near_duplicates(docs(rows)).collect()}
    want = brute_components(rows)
    assert {i: x["component_id"] for i, x in got.items()} == want
    assert all(x["kept"] == (x["component_id"] == i) and x["n_shingles"] == len(shingles(t)) for (i, t, *_) in rows for x in [got[i]])
    kept = {x["doc_id"] for x in nd.drop_near_duplicates(docs(rows)).collect()}
    assert kept == {i for i, c in want.items() if i == c}


def test_a_large_group_of_near_misses(docs, rng, monkeypatch):
    """Members that the star does not join are compared in blocks of a few; links between components are found, false ones aren't."""
    monkeypatch.setattr(nd, "BLOCK", 8)
    base = [f"v{k}" for k in range(150)]
    rows = [(k, edited(rng, base, 3), "en", "s") for k in range(60)]
    assert {x["doc_id"]: x["component_id"] for x in nd.near_duplicates(docs(rows)).collect()} == brute_components(rows)


def test_near_duplicates_on_odd_rows(odd, none):
    got = nd.near_duplicates(odd).collect()
    assert len(got) == 9 and [x["kept"] for x in got if x["doc_id"] is None] == [True] and sum(x["doc_id"] == 4 and x["kept"] for x in got) == 2
    out = nd.drop_near_duplicates(odd)
    assert out.columns == odd.columns and out.where("doc_id = 4").count() == 1 and out.count() == 8
    assert nd.near_duplicates(none).count() == 0 and nd.drop_near_duplicates(none).count() == 0


def test_least_matches_bound_the_miss():
    for t, m in nd.least_matches(0.85):
        tail = lambda k: sum(math.comb(t + 1, j) * 0.85**j * 0.15 ** (t + 1 - j) for j in range(k + 1))  # noqa: E731  P(similarity >= 0.85 | k of t)
        assert tail(m) >= nd.MISS and (m == 0 or tail(m - 1) < nd.MISS)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(5, k) for k in range(200, 260)] + [(7, 7), (8, None), (300, 5), (141, 900), (900, 950)]
    got = {x["node"]: x["component"] for x in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 100 for i in range(100, 141)} | {k: 5 for k in (5, 300, *range(200, 260))} | {141: 141, 900: 141, 950: 141}
    assert got == want
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_repeats(rows, size=50):
    """Repeated and removed words of each row, by runs of text."""
    seen, where = {}, {}
    order = sorted((r for r in {(i, t) for i, t, *_ in rows}), key=lambda r: (r[0] is None, r[0] or 0))
    for i, t in order:
        w = space_words(t)
        for a in range(len(w) - size + 1):
            where.setdefault(tuple(w[a : a + size]), []).append((i, t, a))
    out = {}
    for places in where.values():
        if len(places) > 1:
            for n, (i, t, a) in enumerate(places):
                rep, gone = out.setdefault((i, t), (set(), set()))
                rep.update(range(a, a + size))
                if n:
                    gone.update(range(a, a + size))
    return out


def test_repeated_passages_against_brute_force(docs, rng):
    word = lambda: f"w{rng.randrange(500)}"
    passage = [[word() for _ in range(rng.choice([49, 50, 55, 90]))] for _ in range(6)]
    rows = []
    for i in range(60):
        w = [word() for _ in range(rng.randrange(120))]
        for _ in range(rng.randrange(3)):
            p = list(rng.choice(passage))
            if rng.random() < 0.3:
                p[rng.randrange(len(p))] = "edit"
            at = rng.randrange(len(w) + 1)
            w[at:at] = p[rng.randrange(4) :]
        rows.append((i * 17 % 61, rng.choice([" ", "  ", "\n"]).join(w), "en", "s"))
    rows += [(100, rows[3][1], "en", "s"), (101, "same " * 120, "en", "s"), (102, "a b " * 40 + "end", "en", "s")]
    want = brute_repeats(rows)
    got = {x["doc_id"]: x for x in sd.repeated_passages(docs(rows)).collect()}
    points = lambda spans: {k for s in spans for k in range(s["a"], s["b"])}
    for i, t, *_ in rows:
        rep, gone = want.get((i, t), (set(), set()))
        assert (points(got[i]["repeated"]), points(got[i]["removed"])) == (rep, gone), i
        assert (got[i]["n_words"], got[i]["n_repeated"], got[i]["n_removed"]) == (len(space_words(t)), len(rep), len(gone))
    holders = {}
    for i, t, *_ in sorted(rows):
        w = space_words(t)
        for a in range(len(w) - 49):
            holders.setdefault(tuple(w[a : a + 50]), []).append(i)
    links = {(i, h[0]) for h in holders.values() for i in h if i != h[0]}
    for i, x in got.items():
        assert x["n_links"] == sum(i in p for p in links)
        assert (x["component_id"] == i) == (not any(got[j]["component_id"] == x["component_id"] and j < i for j in got))
    assert all(got[a]["component_id"] == got[b]["component_id"] for a, b in links) and all(got[i]["component_id"] == i for i in got if not any(i in p for p in links))
    cut = {x["doc_id"]: x for x in sd.cut_repeats(docs(rows)).collect()}
    for i, t, *_ in rows:
        left = [w for k, w in enumerate(space_words(t)) if k not in want.get((i, t), (set(), set()))[1]]
        if left or not space_words(t):
            assert space_words(cut[i]["text"]) == left and cut[i]["n_chars"] == len(cut[i]["text"])
            assert (i, t) in want or cut[i]["text"] == t
        else:
            assert i not in cut


def test_repeated_passages_on_odd_rows(odd, none):
    assert sd.repeated_passages(odd).count() == 9 and sd.cut_repeats(odd).columns == odd.columns
    got = {x["doc_id"]: x["n_repeated"] for x in sd.repeated_passages(odd).collect()}
    assert got[7] == 30_000 and got[4] == 0
    assert sd.repeated_passages(none).count() == 0 and sd.cut_repeats(none).count() == 0


def bench_words(x):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (x or "").translate(AZ))


def brute_hits(text, items):
    w, hit, ids = bench_words(text), set(), set()
    for item, t in items:
        b = bench_words(t)
        size = min(10, len(b))
        grams = {tuple(b[i : i + size]) for i in range(len(b) - size + 1)} if b else set()
        for a in range(len(w) - size + 1):
            if tuple(w[a : a + size]) in grams:
                hit |= set(range(a, a + size))
                if item is not None:
                    ids.add(item)
    return len(w), hit, sorted(ids)


@pytest.mark.parametrize("most", [dec.MAX_WORDS, 30])
def test_decontamination_against_brute_force(spark, docs, rng, most):
    word = lambda: rng.choice(["The", "of", "cat", "é1", "dog", "x9", "sun"])
    items = [(k, " ".join(word() for _ in range(rng.choice([1, 2, 3, 9, 10, 14, 25])))) for k in range(14)] + [(3, "rare words stand here"), (None, "no id but words"), (50, None), (51, "..."), (52, "THE cat")]
    rows = []
    for i in range(40):
        w = [word() for _ in range(rng.randrange(30))]
        if rng.random() < 0.5:
            at = rng.randrange(len(w) + 1)
            w[at:at] = (rng.choice(items)[1] or "").split()
        rows.append((i, rng.choice([" ", ", ", "-"]).join(w).upper() if i % 3 else " ".join(w), "en", "s"))
    rows += [(100, None, "en", "s"), (101, rows[1][1], "en", "s")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {x["doc_id"]: x for x in dec.decontaminate(docs(rows), bench, most).collect()}
    for i, t, *_ in rows:
        n, hit, ids = brute_hits(t, items)
        assert (got[i]["n_words"], got[i]["n_hit"], list(got[i]["items"])) == (n, len(hit), ids)
        assert {k for s in got[i]["spans"] for k in range(s["a"], s["b"])} == hit
    clean = {x["doc_id"] for x in dec.clean(docs(rows), bench).collect()}
    assert clean == {i for i, t, *_ in rows if not brute_hits(t, items)[1]}


def test_decontamination_on_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "word")], "item_id long, text string")
    empty = spark.createDataFrame([], "item_id long, text string")
    assert dec.decontaminate(odd, bench).where("n_hit > 0").count() == 2 and dec.decontaminate(odd, empty).count() == 9
    assert dec.clean(odd, bench).count() == 7 and dec.clean(odd, empty).count() == 9 and dec.clean(odd, bench).columns == odd.columns
    assert dec.decontaminate(none, bench).count() == 0 and dec.clean(none, bench).count() == 0


def test_digest_of_items(spark, tmp_path):
    spark.createDataFrame([(1, "a b c"), (2, "z")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(9, "A"), (10, "b c")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {x["doc_id"]: x for x in dec.op5_decontaminate(spark, str(tmp_path)).collect()}
    assert got[1]["items_sha256"] == hashlib.sha256(b"10,9").hexdigest() and got[2]["items_sha256"] == hashlib.sha256(b"").hexdigest() and got[1]["n_items"] == 2


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("module,name", [(nd, "op10_near_dedup"), (sd, "op8_repeated_passages"), (dec, "op5_decontaminate")])
def test_sql(spark, module, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    frame = lambda d: d[sorted(d.columns)].sort_values("doc_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(frame(module.QUERIES[name](spark, SF).toPandas()), frame(con.sql(module.SQL[name]).df()), check_dtype=False)
