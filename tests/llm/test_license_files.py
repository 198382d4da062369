"""Full licence texts, and licence files known by a part of their text."""

import os

import pytest

from stratasieve.llm import license_scan as lic

FULL = {name: text for name, text in lic.TEMPLATES if len(text) > 500 and "\n" in text}


def scan(spark, files):
    df = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(files.items())], "doc_id long, path string, text string")
    return {x["path"]: (x["license"], x["basis"], x["inherited_from"]) for x in lic.scan(df).collect()}


def test_full_texts_are_templates():
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "AGPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "MIT", "ISC", "CC0-1.0"} <= set(FULL)


@pytest.mark.parametrize("name", ["LICENSE", "COPYING.txt", "docs/legal.txt"])
def test_full_texts_lend_their_licence(spark, name):
    files = {}
    for k, (licence, text) in enumerate(FULL.items()):
        files[f"{licence}/{name}"] = f"Copyright (c) 20{k:02d} Some Holder\n\n" + " ".join(text.split())  # wrapped at another width
        files[f"{licence}/{name.rpartition('/')[0]}/src/x{k}.py"] = f"plain code number {k}"
    files |= {f"words/{k}": "other words of other files " + "zebra " * k for k in range(30)}
    got = scan(spark, files)
    for k, licence in enumerate(FULL):
        path = f"{licence}/{name}"
        assert got[path] == (licence, "file", None)
        assert got[f"{licence}/{name.rpartition('/')[0]}/src/x{k}.py"] == (licence, "inherited", path)


def test_named_file_by_a_part(spark):
    long = "\n".join(f"clause {k} of house rules, term{k} and word{k * k}" for k in range(300))
    got = scan(spark, {"a/LICENSE": f"{long}\n\nLicensed under the Apache License, Version 2.0.\n\n{long}", "a/x.py": "code", "b/notes.txt": f"{long}\nLicensed under the Apache License, Version 2.0.", "b/y.py": "code"})
    assert got == {"a/LICENSE": ("Apache-2.0", "file", None), "a/x.py": ("Apache-2.0", "inherited", "a/LICENSE"), "b/notes.txt": ("Apache-2.0", "header", None), "b/y.py": (None, "none", None)}


SYSTEM = "/usr/share/common-licenses"


@pytest.mark.skipif(not os.path.isdir(SYSTEM), reason="no system licences")
def test_system_licences_are_right_or_none(spark):
    """Versions that are no template have no licence, and lend none."""
    right = {"Apache-2.0": "Apache-2.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0"}
    names = [n for n in sorted(os.listdir(SYSTEM)) if not os.path.islink(f"{SYSTEM}/{n}")]
    files = {f"{n}/LICENSE": open(f"{SYSTEM}/{n}", encoding="utf-8").read() for n in names} | {f"{n}/src/x.py": "code" for n in names}
    got = scan(spark, files)
    for n in names:
        assert got[f"{n}/LICENSE"] == ((right[n], "file", None) if n in right else (None, "none", None)), n
        assert got[f"{n}/src/x.py"] == ((right[n], "inherited", f"{n}/LICENSE") if n in right else (None, "none", None)), n


def test_the_query_against_sql_with_planted_files(spark, tmp_path):
    """Files of the query's own table: a licence, a directory that inherits it, headers, and paths without a source."""
    import duckdb
    import pandas as pd

    rows = [(1, FULL["MIT"], "en", "proj/a"), (2, "code of a", "en", "proj/a"), (3, "code of b", "en", "proj/a/b"), (4, "text\nReleased under the MIT License.\nmore", "en", "z"), (5, "Licensed under the Apache License,\nVersion 2.0.", "en", "z"), (6, None, "en", None), (7, "", "en", "proj"), (8, "words " * 40, "de", "y"), (9, FULL["BSD-3-Clause"].replace("Redistribution", "Distribution"), "en", "q"), (10, "other", "en", "q"), (11, "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 1 of the License, or (at your option) any later version.", "en", "v")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    frame = lambda d: d[sorted(d.columns)].sort_values("doc_id").reset_index(drop=True).fillna("")
    got = frame(lic.QUERIES["op7_license_scan"](spark, str(tmp_path)).toPandas())
    pd.testing.assert_frame_equal(got, frame(con.sql(lic.SQL["op7_license_scan"]).df()), check_dtype=False)
    assert {"file", "inherited", "header", "none"} == set(got["basis"])
