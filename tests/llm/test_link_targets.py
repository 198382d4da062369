"""Links without quotes, and relative ones."""

from urllib.parse import urljoin

import pytest

from stratasieve.llm import url_filter as uf

BASES = ["http://h.org/a/b/c.html?x=1#f", "http://h.org", "http://h.org/", "http://h.org/a/b/"]
TARGETS = ["page.html", "./page", "../x", "../../../x?u=../y", "?id=1", "#top", "a/./b/../c", "..", ".", "/r/../s", "/go?u=http://e.com/x", "//o.net/p", "https://o.net/p", "g;x=1/../y", "/"]


def test_targets_resolve_as_in_browsers(spark):
    rows = [(b, t) for b in BASES for t in TARGETS]
    df = spark.createDataFrame(rows, "url string, t string")
    got = {(x["url"], x["t"]): x["a"] for x in df.select("url", "t", uf.address(uf.resolve(df.url, df.t)).alias("a")).collect()}
    slash = lambda a: a if "/" in a else a + "/"
    for b, t in rows:
        assert slash(got[b, t]) == slash(urljoin(b, t).split("#")[0].partition("://")[2]), (b, t)
    none = spark.createDataFrame([("http://h.org/", "mailto:a@b.c"), ("http://h.org/", "javascript:x")], "url string, t string")
    assert none.where(uf.resolve(none.url, none.t).isNotNull()).count() == 0


BLOCKED = "http://b.net/es/x/y"


@pytest.mark.parametrize(
    ("url", "html"),
    [
        ("http://one.org/", f"<link rel=canonical href={BLOCKED}>"),
        ("http://one.org/", f"<LINK href={BLOCKED} rel=canonical>"),
        ("http://one.org/a", f'<link rel="canonical" data-x=1 href={BLOCKED} >'),
        ("http://one.org/q/w", '<link rel="canonical" href="page.html">'),
        ("http://one.org/q/w", "<link rel=canonical href=../q/./page.html>"),
        ("http://one.org/q/page.html?p", '<meta http-equiv=refresh content="0;url=?id=1">'),
    ],
)
def test_linked_pages_are_blocked(spark, url, html):
    links = [("http://one.org/q/page.html", BLOCKED), ("http://one.org/q/page.html?id=1", BLOCKED)]
    pages = spark.createDataFrame([(1, url, html)], "page_id long, url string, html string")
    assert uf.judge(pages, spark.createDataFrame(links, "source string, target string")).collect()[0]["verdict"] == "block"


def test_href_inside_a_quoted_value_is_no_link(spark):
    pages = spark.createDataFrame([(1, "http://one.org/", '<link href="http://two.org/?href=abc" rel=canonical>')], "page_id long, url string, html string")
    assert [x["target"] for x in uf.link_edges(pages).collect()] == ["http://two.org/?href=abc"]
