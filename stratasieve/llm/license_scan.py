"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Words are runs of letters and digits, A-Z in lower case. A unit of text is a line, a paragraph (lines between blank ones) or
the whole text; every unit of every whole text is compared with every template by the cosine of their TF-IDF
vectors. A word of the templates weighs ln((1 + N) / (1 + documents that hold it)), counted over all documents; a word outside
them weighs as one of a single document. A template's words are ordered by weight, and a unit without any of those that a cosine of THRESHOLD
cannot do without is skipped exactly (the other words' share of the template's norm is below it).
A template that names its version (numbers among the VERSION words after its first `version`) only matches units that hold these numbers, which tells close versions apart.
A line or paragraph that reaches THRESHOLD is a header. A whole text that reaches FILE_THRESHOLD makes its file a licence file of its
directory; so does a header under a name such as LICENSE or COPYING, the whole text before its parts. (A named file whose text is only like a template, below FILE_THRESHOLD, is
another licence.)

A file without a licence of its own takes that of the licence file in the nearest directory
above it: each path's ancestors are joined with one row per directory (the least path there), and the deepest is kept.

Defined cases: a text without a licence of its own, such as a null or empty one, has score 0; a null path has no ancestors and inherits nothing. Ties: the higher cosine,
then the template first in order; of licence files in one directory, the least path. Repeated rows give a
row each. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytetext as bt
from .common import columns, materialize

THRESHOLD = 0.6
FILE_THRESHOLD = 0.9
VERSION = 6
#: words of a text that is more than a notice
LONG = 100
_NAMED = r"(?i)(^|/)(licen[sc]e|copying|unlicense)([.-][^/]*)?$"
# Notices that the licences' own publishers ask for, and opening paragraphs of their texts.
_NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software'),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: the notices, and the full texts in the folder `licenses`, each named after its licence
TEMPLATES = _NOTICES + tuple((x.name.removesuffix(".txt"), x.read_text("utf-8")) for x in sorted(resources.files(__package__).joinpath("licenses").iterdir(), key=lambda x: x.name) if x.name.endswith(".txt"))
KINDS = ("line", "paragraph", "whole")


class Terms:
    """The templates' words; after weigh(), their vectors."""

    def __init__(self, templates=TEMPLATES) -> None:
        self.names = [x for x, _ in templates]
        w = bt.one([x for _, x in templates]).words(bt.ALNUM, True)
        self.known, at = np.unique(w.hash, return_inverse=True)
        self.tf = np.zeros((len(templates), len(self.known)))
        np.add.at(self.tf, (w.doc, at), 1)
        self.required = [np.unique(at[f : f + 60][self._version(w.bytes_of(np.arange(f, min(f + 60, e))).to_pylist())]) for f, e in zip(w.first[:-1], w.first[1:])]

    @staticmethod
    def _version(words: list[bytes]) -> list[int]:
        """Places of the numbers among the VERSION words after the first `version`."""
        start = words.index(b"version") + 1 if b"version" in words else len(words)
        return [k for k in range(start, min(start + VERSION, len(words))) if words[k].isdigit()]

    def weigh(self, n: int, df: np.ndarray, threshold: float) -> None:
        self.idf = np.log((1 + n) / (1 + df))
        self.most = float(np.log((1 + n) / 2)) if n > 1 else 1.0
        if n <= 1:
            self.idf = np.ones_like(self.idf)
        v = self.tf * self.idf
        self.vec = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
        need = np.zeros(len(self.known), bool)
        for row in self.vec:
            order = np.argsort(-row, kind="stable")
            rest = np.sqrt(np.maximum(0, 1 - np.cumsum(row[order] ** 2)))  # norm of what comes after
            need[order[: int(np.argmax(rest < threshold)) + 1]] = True
        self.need = need

    def ids(self, h: np.ndarray) -> np.ndarray:
        i = np.searchsorted(self.known, h)
        i[i == len(self.known)] = 0
        return np.where(self.known[i] == h, i, -1)


def _units(t: bt.Texts, w: bt.Words, kind: str) -> np.ndarray:
    """The unit of each word, ascending."""
    if kind == "whole":
        return w.doc
    line = np.searchsorted(np.flatnonzero(t.data == 10), w.start)
    if kind == "paragraph":
        # a new paragraph at a word whose line is more than one after the last word's line
        new = np.concatenate(([True], (np.diff(line) > 1) | (np.diff(w.doc) > 0))) if len(line) else np.zeros(0, bool)
    else:
        new = np.concatenate(([True], (np.diff(line) > 0) | (np.diff(w.doc) > 0))) if len(line) else np.zeros(0, bool)
    return np.cumsum(new) - 1


def best_matches(t: bt.Texts, x: Terms) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """For each kind of unit: the highest cosine of each text, and its template."""
    w = t.words(bt.ALNUM, True)
    ids = x.ids(w.hash)
    out = {}
    for kind in KINDS:
        score, name = np.zeros(t.n), np.full(t.n, -1)
        unit = _units(t, w, kind)
        n_units = int(unit[-1]) + 1 if len(unit) else 0
        live = np.zeros(n_units, bool)
        live[unit[(ids >= 0) & x.need[ids]]] = True
        rows = np.flatnonzero(live[unit]) if n_units else np.zeros(0, np.int64)
        if len(rows):
            tf, first = bt.first_of_equal(unit[rows], w.hash[rows])
            rows, tf = rows[first], tf[first]
            i, u = ids[rows], unit[rows]
            weight = tf * np.where(i >= 0, x.idf[i], x.most)
            number, u = np.unique(u, return_inverse=True)
            norm = np.sqrt(np.bincount(u, weight**2))
            dot = np.zeros((len(number), len(x.names)))
            known = i >= 0
            np.add.at(dot, u[known], weight[known, None] * x.vec.T[i[known]])
            cos = dot / np.maximum(norm, 1e-300)[:, None]
            for j, numbers in enumerate(x.required):
                held = np.zeros(len(number), np.int64)
                np.add.at(held, u[np.isin(i, numbers)], 1)
                cos[held < len(numbers), j] = 0
            best = cos.argmax(1)
            top = np.minimum(cos[np.arange(len(number)), best], 1.0)
            doc = w.doc[rows][np.unique(u, return_index=True)[1]]
            order = np.lexsort((best, -top, doc))
            head = order[np.concatenate(([True], doc[order][1:] != doc[order][:-1]))]
            score[doc[head]], name[doc[head]] = top[head], best[head]
        out[kind] = (score, name)
    return out


def terms(texts: DataFrame, threshold: float = THRESHOLD, templates=TEMPLATES) -> Terms:
    """The templates' vectors, with document frequencies over all texts."""
    x = Terms(templates)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(len(x.known), np.int64), 0
        for b in batches:
            n += b.num_rows
            for _, _, t in bt.slices(b["text"]):
                w = t.words(bt.ALNUM, True)
                i = x.ids(w.hash)
                seen = np.unique(w.doc[i >= 0] * len(x.known) + i[i >= 0])
                df += np.bincount(seen % len(x.known), minlength=len(df))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(df))), pa.array(np.concatenate(([n], df)))], ["i", "n"])

    total = {r["i"]: r["n"] for r in columns(texts, text="string").mapInArrow(count, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()}  # a row per template word
    x.weigh(total.get(-1, 0), np.array([total.get(k, 0) for k in range(len(x.known))], np.float64), threshold)
    return x


def own_licenses(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, path, n_words, and license and score by kind of unit."""
    x = files.sparkSession.sparkContext.broadcast(terms(files, threshold))  # bounded by the templates

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*x.value.names, None], object)
        for b in batches:
            for i, j, t in bt.slices(b["text"]):
                found = best_matches(t, x.value)
                cols = [b["doc_id"].slice(i, j - i), b["path"].slice(i, j - i), pa.array(t.words(bt.ALNUM, True, False).count, pa.int64())]
                for kind in KINDS:
                    score, name = found[kind]
                    cols += [pa.array(names[np.where(score >= threshold, name, -1)].tolist(), pa.string()), pa.array(np.where(score >= threshold, score, 0.0))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "path", "n_words", *[c for k in KINDS for c in (k, f"{k}_score")]])

    return columns(files, doc_id="long", path="string", text="string").mapInArrow(scan, "doc_id long, path string, n_words long, " + ", ".join(f"{k} string, {k}_score double" for k in KINDS))


def directory(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def scan(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, path, n_words, license, score, basis (header, file, inherited or none) and inherited_from of every file of doc_id, path, text."""
    own = materialize(own_licenses(files, threshold), "licenses")
    header = F.when(F.col("line").isNotNull() & (F.col("paragraph").isNull() | (F.col("line_score") >= F.col("paragraph_score"))), F.struct(F.col("line").alias("license"), F.col("line_score").alias("score"))).otherwise(F.struct(F.col("paragraph").alias("license"), F.col("paragraph_score").alias("score")))
    named = F.coalesce(F.col("path").rlike(_NAMED), F.lit(False))
    own = own.withColumn("whole", F.when(F.col("whole_score") >= FILE_THRESHOLD, F.col("whole"))).withColumn("like", (F.col("whole_score") > 0) & F.col("whole").isNull())
    own = own.withColumn("h", header).withColumn("license", F.coalesce("whole", F.when(~(named & F.col("like") & (F.col("n_words") > LONG)), F.col("h.license"))))
    own = own.withColumn("score", F.when(F.col("whole").isNotNull(), F.col("whole_score")).when(F.col("license").isNotNull(), F.col("h.score")).otherwise(0.0))
    own = own.withColumn("basis", F.when(F.col("whole").isNotNull() | (named & F.col("license").isNotNull()), "file").when(F.col("license").isNotNull(), "header").otherwise("none"))
    own = own.select("doc_id", "path", "n_words", "license", "score", "basis")
    by_dir = materialize(own.where("basis = 'file' and path is not null").groupBy(directory(F.col("path")).alias("dir")).agg(F.min(F.struct("path", "license")).alias("f")).selectExpr("dir", "f.path as inherited_from", "f.license as inherited"), "directories")
    if by_dir.isEmpty():
        return own.withColumn("inherited_from", F.lit(None).cast("string"))
    # directories, not files, are joined: a hot directory is one row
    dirs = own.where("basis = 'none' and path is not null").select(directory(F.col("path")).alias("of")).distinct()
    up = dirs.select("of", F.posexplode(F.expr("transform(sequence(0, size(split(of, '/'))), n -> array_join(slice(split(of, '/'), 1, n), '/'))")).alias("depth", "dir")).distinct()
    near = up.join(by_dir, "dir").groupBy("of").agg(F.max(F.struct("depth", "inherited_from", "inherited")).alias("x")).selectExpr("of", "x.inherited_from", "x.inherited")
    near = materialize(near, "nearest")
    out = own.withColumn("of", F.when(F.col("basis") == "none", directory(F.col("path")))).join(near, "of", "left")
    return out.select("doc_id", "path", "n_words", F.coalesce("license", "inherited").alias("license"), "score", F.when(F.col("inherited").isNotNull(), "inherited").otherwise(F.col("basis")).alias("basis"), "inherited_from")


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    docs = columns(spark.read.parquet(f"{sf_dir}/documents.parquet"), doc_id="long", source="string", text="string")
    return scan(docs.select("doc_id", F.concat_ws("/", "source", "doc_id").alias("path"), "text")).withColumn("score", F.round("score", 6))


def _sql() -> str:
    """Cosines over the templates' words as values; nearest licence file by joins. Scores are compared to six digits."""
    x, vectors = Terms(), []
    words = [w.decode() for _, t in TEMPLATES for w in bt.one([t]).words(bt.ALNUM, True).bytes_of(np.arange(bt.one([t]).words(bt.ALNUM, True).first[-1])).to_pylist()]
    at = np.concatenate(([0], np.cumsum([bt.one([t]).words(bt.ALNUM, True, False).first[-1] for _, t in TEMPLATES])))
    for k in range(len(TEMPLATES)):
        mine = words[at[k] : at[k + 1]]
        need = {mine[i] for i in Terms._version([w.encode() for w in mine[:60]])}
        vectors += [f"({k},'{w}',{mine.count(w)},{int(w in need)})" for w in dict.fromkeys(mine)]
    names = ",".join(f"({k},'{n}')" for k, n in enumerate(x.names))
    split = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    rx = _NAMED.removeprefix("(?i)")
    folder = "case when contains({0}, '/') then regexp_replace({0}, '/[^/]*$', '') else '' end"
    return f"""
with v(t, w, tf, need) as (values {",".join(vectors)}), nm(t, name) as (values {names}),
d as (select doc_id, concat_ws('/', source, doc_id) as path, text, row_number() over () as r from documents),
l as (select r, i, {split.format("line")} as ws from (select r, unnest(string_split(coalesce(text, ''), chr(10))) as line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as i from d)),
lw as (select *, len(ws) as n from l where len(ws) > 0),
pa as (select *, sum(new) over (partition by r order by i) as p from (select *, case when i - lag(i) over (partition by r order by i) = 1 then 0 else 1 end as new from lw)),
w as (select r, i, p, unnest(ws) as w from pa),
u as (select r, 'line' as kind, i as unit, w, count(*) as tf from w group by all union all select r, 'paragraph', p, w, count(*) from w group by all union all select r, 'whole', 0, w, count(*) from w group by all),
n as (select count(*) as n from d),
idf as (select v.w, ln((1 + (select n from n)) / (1 + coalesce(df.n, 0))::double) as idf from (select distinct w from v) v left join (select w, count(distinct r) as n from w where w in (select w from v) group by 1) df on df.w = v.w),
tv as (select v.t, v.w, v.need, v.tf * idf as x from v join idf on idf.w = v.w),
tn as (select t, sqrt(sum(x * x)) as norm, sum(need) as needs from tv group by 1),
uw as (select u.r, u.kind, u.unit, u.w, u.tf * coalesce(idf.idf, ln((1 + (select n from n)) / 2.0)) as x from u left join idf on idf.w = u.w),
un as (select r, kind, unit, sqrt(sum(x * x)) as norm from uw group by all),
c as (select uw.r, uw.kind, uw.unit, tv.t, sum(uw.x * tv.x) as dot, sum(tv.need) as held from uw join tv on tv.w = uw.w group by all),
s as (select c.r, c.kind, c.t, least(dot / un.norm / tn.norm, 1.0) as cos from c join un on un.r = c.r and un.kind = c.kind and un.unit = c.unit join tn on tn.t = c.t where held = needs),
b as (select r, kind, max(cos) as cos, arg_min(t, t - round(cos, 9) * 1000000) as t from s where cos >= {THRESHOLD} group by all),
o as (select d.r, d.doc_id, d.path, coalesce((select sum(n) from lw where lw.r = d.r), 0)::bigint as n_words, regexp_matches(coalesce(path, ''), '{rx}', 'i') as named, bl.cos as lc, bl.t as lt, bp.cos as pc, bp.t as pt, bw.cos as wc, bw.t as wt
  from d left join b bl on bl.r = d.r and bl.kind = 'line' left join b bp on bp.r = d.r and bp.kind = 'paragraph' left join b bw on bw.r = d.r and bw.kind = 'whole'),
h as (select *, wc >= {FILE_THRESHOLD} as file, named and wc < {FILE_THRESHOLD} and n_words > {LONG} as other, case when lt is not null and (pt is null or lc >= pc - 1e-9) then lt else pt end as ht, case when lt is not null and (pt is null or lc >= pc - 1e-9) then lc else pc end as hc from o),
f as (select r, doc_id, path, n_words, case when file then wt when not coalesce(other, false) then ht end as t, case when file then wc when not coalesce(other, false) then hc end as cos, case when file or (named and ht is not null and not coalesce(other, false)) then 'file' when ht is not null and not coalesce(other, false) then 'header' else 'none' end as basis from h),
g as (select {folder.format("path")} as dir, min(path) as inherited_from, arg_min(t, path) as t from f where basis = 'file' and path is not null group by 1),
a as (select r, unnest(range(0, len(string_split(dir, '/')) + 1)) as depth, dir from (select r, {folder.format("path")} as dir from f where basis = 'none' and path is not null)),
q as (select a.r, max(depth) as depth, arg_max(g.inherited_from, depth) as inherited_from, arg_max(g.t, depth) as t from a join g on g.dir = array_to_string(string_split(a.dir, '/')[1:depth], '/') group by 1)
select f.doc_id, f.path, f.n_words, nm.name as license, round(coalesce(f.cos, 0), 6)::double as score, case when q.t is not null then 'inherited' else f.basis end as basis, q.inherited_from
from f left join q on q.r = f.r left join nm on nm.t = coalesce(f.t, q.t)"""


QUERIES = {"op7_license_scan": op7_license_scan}
SQL = {"op7_license_scan": _sql()}
