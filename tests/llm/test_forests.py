"""Links become forests before stars are contracted."""

import pytest

from stratasieve.llm import near_dedup as nd
from stratasieve.llm.common import components


@pytest.mark.parametrize("links", [1 << 18, 50])
def test_forests_keep_components(spark, monkeypatch, links):
    monkeypatch.setattr(nd, "LINKS", links)
    chain = [(x, x + 1) for x in range(300)]
    far = [(1000 + 7 * x % 100, 1000 + x) for x in range(100)] + [(2000, 2001), (2001, 2000)]
    edges = spark.createDataFrame(chain + far, "a long, b long").repartition(8)
    stars = nd._forests(edges)
    assert stars.count() <= (400 if links > 1000 else edges.count())
    got = {(x["node"], x["component"]) for x in components(stars).collect()}
    assert got == {(x["node"], x["component"]) for x in components(edges).collect()}


def test_few_links_need_no_round(spark, monkeypatch):
    from stratasieve.llm import common

    asked, stars = [], common._stars
    monkeypatch.setattr(common, "_stars", lambda e: asked.append(stars(e)) or asked[-1])
    edges = spark.createDataFrame([(x, x + 1) for x in range(100)], "a long, b long").repartition(8)
    assert {x["component"] for x in components(nd._forests(edges)).collect()} == {0} and asked == [True]
