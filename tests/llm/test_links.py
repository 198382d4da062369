"""URL filter, quotation linking and license scan; the pipeline."""

import math
import os
from collections import Counter

import duckdb
import pandas as pd
import pytest

from stratasieve.llm import bytetext as bt
from stratasieve.llm import license_scan as lic
from stratasieve.llm import quote_links as ql
from stratasieve.llm import url_filter as uf

SF = "/root/testdata/sf0.001"
PAGES = [
    (1, "https://shop.example.org/a", '<LINK rel="canonical" href="http://example.com/en/x">'),
    (2, "https://www.example.com/en/y", '<link href="https://example.com/en/x" rel=canonical>'),
    (3, "http://other.org/", '<meta http-equiv="refresh" content="0; url=http://shop.example.org/a#top">'),
    (4, "http://lone.org/p?q=1#f", "<p>canonical</p>"),
    (5, "http://a.net/es/1", None),
    (6, "http://b.NET/it/", '<link rel="canonical" href="/fr/2">'),
    (7, None, '<link rel="canonical" href="http://example.com/en/x">'),
    (8, "no scheme", ""),
    (9, "HTTP://Example.COM/en", ""),
    (9, "HTTP://Example.COM/en", ""),
    (None, "http://notexample.com/en/", ""),
    (11, "http://third.org/", '<link rel="canonical" href="http://other.org/">'),
    (12, "x://example.com?y/en/", ""),
]


def pages(spark):
    return spark.createDataFrame([(*p, "x", 1) for p in PAGES], "page_id long, url string, html string, host string, node int")


def test_aliases_take_block_decisions(spark):
    got = {x["page_id"]: (x["host"], x["path"], x["rule"], x["verdict"]) for x in uf.judge(pages(spark)).collect()}
    assert got[1] == ("shop.example.org", "/a", None, "block") and got[3][3] == "block" and got[11][3] == "block"  # through the chain
    assert got[2] == ("www.example.com", "/en/y", "www.example.com/en/", "allow")  # an explicit allow stands
    assert got[4] == ("lone.org", "/p", None, "allow") and got[5][2:] == ("net/es/", "block") and got[6][2:] == (None, "block")
    assert got[7] == ("", "", None, "allow") and got[8] == ("", "", None, "allow") and got[9] == ("example.com", "/en", "com/", "allow")
    assert got[None] == ("notexample.com", "/en/", "com/", "allow") and got[12][:2] == ("example.com", "")
    more = spark.createDataFrame([("http://lone.org/p?q=1", "http://x.net/fr/")], "source string, target string")
    assert {x["page_id"]: x["verdict"] for x in uf.judge(pages(spark), more).collect()}[4] == "block"
    assert uf.judge(pages(spark)).count() == len(PAGES) and uf.judge(pages(spark).limit(0)).count() == 0


def test_url_sql_on_links(spark, tmp_path):
    pages(spark).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.sql(f"create view pages as select page_id, url, html from '{tmp_path}/pages.parquet/*.parquet'")
    rows = lambda d: sorted(tuple("" if pd.isna(v) else str(v).removesuffix(".0") for v in r) for r in d[sorted(d.columns)].itertuples(index=False))
    assert rows(uf.op6_url_filter(spark, str(tmp_path)).toPandas()) == rows(con.sql(uf.SQL["op6_url_filter"]).df())


TALK = [
    (1, 0, "user", "Hello there.\nHow are you?"),
    (1, 1, "assistant", "> how are YOU\n\nFine!"),
    (1, 2, "user", "> > How are you?\n> Fine!\nGood to hear.\n"),
    (1, 3, "user", ">  nobody said this\nA new topic"),
    (1, 4, "user", "> Hello there\nHi"),
    (1, 5, "user", "> Good to hear\n> A new topic"),
    (2, 0, "user", "> Fine!\nquote of another conversation"),
    (2, 1, None, None),
    (2, 2, "user", "> ...\n>\n"),
    (None, 1, "user", "> Fine!"),
    (2, None, "user", "> Fine!"),
    (3, 1, "user", "twice"),
    (3, 1, "user", "twice"),
    (3, 2, "user", "  >twice\nok"),
]


def talk(spark, rows=TALK):
    return spark.createDataFrame([(*r, "x", 3) for r in rows], "conv_id long, turn long, role string, text string, h string, level int")


def test_quotes_link_to_the_first_who_said_it(spark):
    got = {(x["conv_id"], x["turn"]): x for x in ql.build_conversations(talk(spark)).collect()}
    g = lambda c, t: tuple(got[c, t][k] for k in ("text", "parent", "thread", "depth", "links", "max_level"))
    assert g(1, 1) == ("Fine!", 0, 0, 1, 1, 1)
    assert g(1, 2) == ("Good to hear.", 1, 0, 2, 2, 2)
    assert g(1, 3) == ("A new topic", None, 3, 0, 0, 1)
    assert g(1, 4) == ("Hi", 0, 0, 1, 1, 1)
    assert g(1, 5) == ("", 3, 3, 1, 2, 1)  # two originals at one level: the later
    assert g(2, 0)[1] is None and g(2, 1)[0] == "" and g(2, 2)[0] == "" and g(3, 2)[:2] == ("ok", 1)
    assert ql.build_conversations(talk(spark)).count() == len(TALK) and ql.build_conversations(talk(spark).limit(0)).count() == 0
    seen = {}
    for x in ql.ordered(ql.build_conversations(talk(spark).where("conv_id = 1"))).collect():
        assert x["parent"] is None or x["parent"] in seen
        seen[x["turn"]] = 1


def test_quotes_sql_and_long_chains(spark, tmp_path):
    chain = [(7, k, "user", (f"> line {k - 1}\n" if k else "") + f"line {k}") for k in range(40)]
    rows = [r for r in TALK if r[0] is not None and r[1] is not None and r[0] != 3] + chain
    talk(spark, rows).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.sql(f"create view conversations as select conv_id, turn, role, text from '{tmp_path}/conversations.parquet/*.parquet'")
    a, b = ql.op2_quote_links(spark, str(tmp_path)).toPandas(), con.sql(ql.SQL["op2_quote_links"]).df()
    assert a["depth"].max() == 39
    frame = lambda d: d[sorted(d.columns)].astype({"parent": "Int64"}).fillna({"role": ""}).sort_values(["conv_id", "turn"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(frame(a), frame(b), check_dtype=False)


def test_native_plan(spark):
    plan = ql.build_conversations(talk(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def brute_cosine(unit, corpus, templates):
    """Best cosine of a list of words to the templates, with document frequencies over the corpus."""
    known = {w for t in templates for w in t}
    df = Counter(w for d in corpus for w in set(d) if w in known)
    idf = lambda w: math.log((1 + len(corpus)) / (1 + df[w])) if w in known else math.log((1 + len(corpus)) / 2)
    vec = lambda ws: {w: n * idf(w) for w, n in Counter(ws).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values())) or 1e-300
    u = vec(unit)

    def numbers(t):
        head = t[:60]
        at = head.index("version") + 1 if "version" in head else 60
        return {w for w in head[at : at + 6] if w.isdigit()}

    return max(sum(u.get(w, 0) * x for w, x in vec(t).items()) / norm(u) / norm(vec(t)) if numbers(t) <= set(unit) else 0 for t in templates)


def test_license_cosine_against_brute_force(spark, rng):
    words = lambda x: [w for w in "".join(c if c.isalnum() else " " for c in x.lower()).split()]
    templates = [words(t) for _, t in lic.TEMPLATES]
    texts = ["Released under the MIT License.", "the license of the work", "plain text here", "a\n\nLicensed under the Apache\nLicense, Version 2.0.\n\nb"] + [" ".join(rng.choice(["the", "license", "under", "zebra", "gnu", "public"]) for _ in range(12)) for _ in range(20)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    x = lic.terms(df, threshold=0.0001)
    got = lic.best_matches(bt.one(texts), x)["whole"][0]
    corpus = [words(t) for t in texts]
    for i, t in enumerate(texts):
        assert got[i] == pytest.approx(brute_cosine(corpus[i], corpus, templates), abs=1e-9)
    # the prefix filter loses nothing above the threshold
    full = lic.best_matches(bt.one(texts), lic.terms(df, threshold=0.6))["whole"][0]
    assert [round(a, 9) for a, b in zip(got, full) if a >= 0.6] == [round(b, 9) for a, b in zip(got, full) if a >= 0.6]


FILES = [(1, "a/LICENSE", "Licensed under the Apache License, Version 2.0."), (2, "a/b/c/x.py", "hello"), (3, "a/b/y.py", "foo is a function of many words\nReleased under the MIT License.\nbar"), (4, "z/q", None), (5, None, "zz"), (6, "a/b/COPYING", "Released under the MIT License"), (7, "a/k", "words"), (7, "a/k", "words"), (8, "top", "x"), (9, "a/b/copying.txt", "Licensed under CC BY-NC 4.0.")]


def test_nearest_directory(spark):
    df = spark.createDataFrame([(*f, 1) for f in FILES], "doc_id long, path string, text string, license int")
    got = {x["doc_id"]: (x["license"], x["basis"], x["inherited_from"]) for x in lic.scan(df).collect()}
    assert got == {1: ("Apache-2.0", "file", None), 2: ("MIT", "inherited", "a/b/COPYING"), 3: ("MIT", "header", None), 4: (None, "none", None), 5: (None, "none", None), 6: ("MIT", "file", None), 7: ("Apache-2.0", "inherited", "a/LICENSE"), 8: (None, "none", None), 9: ("CC-BY-NC-4.0", "file", None)}
    assert lic.scan(df).count() == len(FILES) and lic.scan(df.limit(0)).count() == 0


def test_license_on_odd_rows(odd):
    assert lic.scan(odd.selectExpr("*", "concat(source, '/', doc_id) as path")).count() == 9


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_planted_license_lines(spark):
    got = lic.op7_license_scan(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for line, name in (("Licensed under the Apache License, Version 2.0.", "Apache-2.0"), ("Released under the MIT License.", "MIT"), ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0")):
        ids = {x[0] for x in docs.where(docs.text.contains(line)).select("doc_id").collect()}
        assert ids <= {x[0] for x in got.where(f"license = '{name}' and basis <> 'inherited'").select("doc_id").collect()}
