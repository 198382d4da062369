"""Queries of scalars over documents reach every part of a text: brute force on a long one."""

import hashlib
from collections import Counter

import duckdb
import pytest

from stratasieve.plans import catalogue

LONG = "\n".join(f"line {k} of a long text, {'x' * (k % 50)} end {k * k}" for k in range(900))
TEXTS = {1: LONG, 2: "", 3: "ab", 4: "one\n\ntwo é lines\n", 5: "y" * 30_000, 6: "é" * 40}


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def got(spark, folder, name):
    return Counter(map(tuple, catalogue.QUERIES[name](spark, folder).collect()))


def redacted(v):
    if "\n" in v:
        return v.split("\n")[0] + "...redacted..."
    return "*" * len(v) if len(v) <= 6 else v[:3] + "*" * (len(v) - 5) + v[-2:]


def spans():
    for i, t in TEXTS.items():
        t, w = "".join(c if " " <= c <= "~" or c == "\n" else "?" for c in t), 3 + i % 7
        for k in range(9):
            a = max(len(t) - w, 0) * k // 8
            yield i, t, a, a + w


def test_values_are_whole_texts_and_all_lines(spark, folder):
    values = [(i, v) for i, t in TEXTS.items() for v in (t, *t.split("\n"))]
    assert got(spark, folder, "redact_values") == Counter((i, redacted(v)) for i, v in values)
    assert got(spark, folder, "fingerprints") == Counter((i, hashlib.sha256(v.encode()).hexdigest()) for i, v in values)


def test_spans_lie_in_the_whole_text(spark, folder):
    inside = [x for x in spans() if x[3] <= len(x[1])]
    assert max(b for i, _, _, b in inside if i == 1) == len(LONG)
    assert got(spark, folder, "line_numbers") == Counter((i, 1 + t[:a].count("\n")) for i, t, a, _ in spans())
    assert got(spark, folder, "match_lines") == Counter((i, t[:a].split("\n")[-1] + t[a:b] + t[b:].split("\n")[0]) for i, t, a, b in inside)
    assert got(spark, folder, "snippets") == Counter((i, " ".join(x for x in (t[max(a - 24, 0) : a].strip(), t[a:b], t[b : b + 24].strip()) if x)) for i, t, a, b in inside)


@pytest.mark.parametrize("name", ["redact_values", "fingerprints", "snippets", "line_numbers", "match_lines"])
def test_sql_agrees(spark, folder, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    assert Counter(map(tuple, con.sql(catalogue.SQL[name]).df().itertuples(index=False))) == got(spark, folder, name)
