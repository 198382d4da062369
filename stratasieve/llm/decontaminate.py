"""Benchmark decontamination by a prefix-filtered set join.

Every window (WINDOW consecutive item words; a shorter item is one window) is a set of shingles. Shingles
are ordered by rarity over all documents; since a window must occur whole, its necessary prefix is its
one rarest shingle. A document word run is a candidate only where it equals a prefix shingle; the
shingle's place in the window fixes where the window would begin (positional bound) and it must end
inside the document (length bound). Survivors are compared word by word, in their bytes.

Items are taken in blocks of at most MAX_WORDS words (a longer item is a block alone), whose windows are broadcast, one block at a time:
counted over all documents, then looked for in all documents; a block's hits are written and its broadcast is
destroyed before the next one is read. Hits are merged per document. A benchmark of one block takes the same way.

Defined cases: null or empty texts have no words and no hits; an item without words, or null, has no
windows. A null item_id still marks words as hit but is not listed or counted; repeated item ids count
once. Repeated documents give a row each. An empty benchmark gives no hits, an empty table no rows.
Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as bt
from .common import columns, materialize, near

WINDOW = 10
SHINGLE = 3
#: words of items that are broadcast at once (about 60 bytes each with their windows)
MAX_WORDS = 1_000_000


class Windows:
    """Distinct windows of a block of items, by their number of words."""

    def __init__(self, items: list[tuple[int | None, str]], window: int = WINDOW, shingle: int = SHINGLE) -> None:
        t = bt.one([x for _, x in items])
        w = t.words(bt.ALNUM, True)
        ids = np.array([-1 if i is None else k for k, (i, _) in enumerate(items)], np.int64)
        names = {}  # equal ids are one item
        for k, (i, _) in enumerate(items):
            if i is not None:
                ids[k] = names.setdefault(i, len(names))
        self.names = np.array(list(names), np.int64)
        size = np.minimum(w.count, window)
        n = np.where(size > 0, w.count - size + 1, 0)
        item = np.repeat(np.arange(t.n), n)
        at = np.repeat(w.first[:-1] - np.concatenate(([0], np.cumsum(n)))[:-1], n) + np.arange(n.sum())
        key, length = w.runs(at, at + size[item]), size[item]
        self.key, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        self.len = length[first]
        self.words = w.bytes_of(np.arange(len(w.start)))
        self.begin = at[first]  # of each window's first word among them
        pair = np.unique(np.stack((inverse, ids[item]), 1)[ids[item] >= 0], axis=0) if len(item) else np.zeros((0, 2), np.int64)
        self.item, self.item_at = pair[:, 1], np.searchsorted(pair[:, 0], np.arange(len(first) + 1))
        # shingles of each window: their hash and place
        self.k = np.minimum(self.len, shingle)
        m = self.len - self.k + 1
        win = np.repeat(np.arange(len(first)), m)
        place = np.arange(m.sum()) - np.repeat(np.concatenate(([0], np.cumsum(m)))[:-1], m)
        self.shingles = (win, place, w.runs(at[first][win] + place, at[first][win] + place + self.k[win]) if len(win) else np.zeros(0, np.uint64))
        self.known = np.unique(self.shingles[2])
        self.sizes = [int(x) for x in np.unique(self.k)]

    def choose(self, seen: np.ndarray) -> None:
        """Keep each window's rarest shingle (ties: least hash, then first place). seen: how often each known shingle occurs."""
        win, place, sh = self.shingles
        often = seen[np.searchsorted(self.known, sh)]
        order = np.lexsort((place, sh, often, win))
        best = order[np.concatenate(([True], win[order][1:] != win[order][:-1]))] if len(order) else order
        order = best[np.argsort(sh[best], kind="stable")]
        self.prefix, start = np.unique(sh[order], return_index=True)
        self.at = np.append(start, len(order))
        self.win, self.place = win[order], place[order]
        self.shingles = None

    def grams(self, w: bt.Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for k in self.sizes:
            yield w.grams(k)

    def hits(self, w: bt.Words) -> tuple[np.ndarray, np.ndarray]:
        """Where windows occur: the first word's number in the slice and the window."""
        starts, wins = [], []
        for at, g in self.grams(w):
            i = np.searchsorted(self.prefix, g)
            i[i == len(self.prefix)] = 0
            ok = np.flatnonzero(self.prefix[i] == g)
            i, at = i[ok], at[ok]
            n = self.at[i + 1] - self.at[i]
            row = np.repeat(self.at[i] - np.concatenate(([0], np.cumsum(n)))[:-1], n) + np.arange(n.sum())
            win, start = self.win[row], np.repeat(at, n) - self.place[row]
            doc = np.repeat(w.doc[at], n)
            ok = (start >= w.first[doc]) & (start + self.len[win] <= w.first[doc + 1])
            win, start = win[ok], start[ok]
            ok = w.runs(start, start + self.len[win]) == self.key[win]
            win, start = win[ok], start[ok]
            same = np.ones(len(win), bool)
            for k in range(int(self.len[win].max(initial=0))):
                has = np.flatnonzero(same & (self.len[win] > k))
                same[has] = np.asarray(pc.equal(w.bytes_of(start[has] + k), self.words.take(pa.array(self.begin[win[has]] + k))))
            starts.append(start[same])
            wins.append(win[same])
        return (np.concatenate(starts), np.concatenate(wins)) if starts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _blocks(benchmark: DataFrame, most: int) -> Iterator[list[tuple[int | None, str]]]:
    """Items with a text, in blocks of about `most` words; a longer item is a block alone."""
    items, words = [], 0
    for r in columns(benchmark, item_id="long", text="string").where("text is not null").toLocalIterator():
        n = int(bt.one([r["text"]]).words(bt.ALNUM, True, False).count[0])
        if items and words + n > most:
            yield items
            items, words = [], 0
        items.append((r["item_id"], r["text"]))
        words += n
    if items:
        yield items


def windows(docs: DataFrame, benchmark: DataFrame, most: int = MAX_WORDS) -> Iterator[Windows]:
    """Each block's windows, their prefix shingles chosen by counts over all documents. An empty benchmark is one empty block."""
    spark, some = docs.sparkSession, False
    for items in _blocks(benchmark, most):
        some, found = True, Windows(items)
        b = spark.sparkContext.broadcast(found)  # bounded by `most`

        def count(batches: Iterator[pa.RecordBatch], b=b) -> Iterator[pa.RecordBatch]:
            x, n = b.value, np.zeros(len(b.value.known), np.int64)
            if not len(x.known):
                return
            for batch in batches:
                for _, _, t in bt.slices(batch["text"]):
                    for _, g in x.grams(t.words(bt.ALNUM, True)):
                        i = np.searchsorted(x.known, g)
                        i[i == len(x.known)] = 0
                        n += np.bincount(i[x.known[i] == g], minlength=len(n))
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n)), pa.array(n[n > 0])], ["i", "n"])

        total = columns(docs, text="string").mapInArrow(count, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()  # a row per shingle of this block
        seen = np.zeros(len(found.known), np.int64)
        seen[total["i"].to_numpy()] = total["n"].to_numpy()
        b.destroy()
        found.choose(seen)
        yield found
    if not some:
        found = Windows([])
        found.choose(np.zeros(0, np.int64))
        yield found


def _find(x: Windows, t: bt.Texts) -> tuple[bt.Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, whether each is hit, and the pairs (text, item) sorted."""
    w = t.words(bt.ALNUM, True)
    start, win = x.hits(w)
    edge = np.zeros(len(w.start) + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + x.len[win], -1)
    hit = np.cumsum(edge)[:-1] > 0
    n = x.item_at[win + 1] - x.item_at[win]
    row = np.repeat(x.item_at[win] - np.concatenate(([0], np.cumsum(n)))[:-1], n) + np.arange(n.sum())
    pair = np.unique(np.stack((np.repeat(w.doc[start], n), x.names[x.item[row]]), 1), axis=0) if len(row) else np.zeros((0, 2), np.int64)
    return w, hit, win, pair[:, 0], pair[:, 1]


def _lists(doc: np.ndarray, values: np.ndarray, n: int, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)), pa.int32()), pa.array(values, kind))


def _runs(w: bt.Words, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and end (counted in the text) of each run of hit words."""
    new = hit & ~(np.concatenate(([False], hit[:-1])) & np.concatenate(([False], w.doc[1:] == w.doc[:-1]))) if len(hit) else hit
    a = np.flatnonzero(new)
    stop = hit & ~(np.concatenate((hit[1:], [False])) & np.concatenate((w.doc[1:] == w.doc[:-1], [False]))) if len(hit) else hit
    b = np.flatnonzero(stop) + 1
    return w.doc[a], a - w.first[w.doc[a]], b - w.first[w.doc[a]]


_SPANS = "array<struct<a:bigint,b:bigint>>"
_OUT = f"doc_id long, key long, n_words long, items array<long>, spans {_SPANS}"


def _keyed(docs: DataFrame) -> DataFrame:
    return columns(docs, doc_id="long", text="string").withColumn("key", F.xxhash64("doc_id", "text"))


def _scan(keyed: DataFrame, b, every: bool) -> DataFrame:
    """_OUT for one block: of every row, or of those with hits (n_words is 0 there)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = b.value
        for batch in batches:
            for i, j, t in bt.slices(batch["text"]):
                w, hit, _, doc, item = _find(x, t)
                rd, a, e = _runs(w, hit)
                spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(rd, np.arange(t.n + 1)), pa.int32()), pa.StructArray.from_arrays([pa.array(a, pa.int64()), pa.array(e, pa.int64())], ["a", "b"]))
                out = pa.RecordBatch.from_arrays([batch["doc_id"].slice(i, j - i), batch["key"].slice(i, j - i), pa.array(w.count, pa.int64()), _lists(doc, item, t.n, pa.int64()), spans], ["doc_id", "key", "n_words", "items", "spans"])
                yield out if every else out.filter(pa.array(np.bincount(w.doc[hit], minlength=t.n) > 0))

    return keyed.mapInArrow(scan, _OUT)


def _merged(spans: str) -> str:
    """SQL: sorted spans, those that touch joined."""
    step = "case when size(acc) > 0 and element_at(acc, -1).b >= x.a then concat(slice(acc, 1, size(acc) - 1), array(named_struct('a', element_at(acc, -1).a, 'b', greatest(element_at(acc, -1).b, x.b)))) else concat(acc, array(x)) end"
    return f"aggregate(array_sort({spans}), cast(array() as {_SPANS}), (acc, x) -> {step})"


def _hits(docs: DataFrame, benchmark: DataFrame, most: int, every: bool) -> tuple[DataFrame, list[DataFrame]]:
    """_OUT of the first block (every row, or hits), and hits of the others: written tables."""
    keyed, out = _keyed(docs), []
    for found in windows(docs, benchmark, most):
        b = docs.sparkSession.sparkContext.broadcast(found)
        out.append(materialize(_scan(keyed, b, every and not out), "hits"))
        b.destroy()
    return out[0], out[1:]


def decontaminate(docs: DataFrame, benchmark: DataFrame, most: int = MAX_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, items (ids of items with occurring windows) and spans (runs of hit words) of each document."""
    first, more = _hits(docs, benchmark, most, True)
    rows = first.select("doc_id", "key", "n_words", "items", "spans")
    if more:
        rest = more[0]
        for x in more[1:]:
            rest = rest.unionByName(x)
        # a list and a list of spans per block and text; equal rows of one text are one
        rest = rest.dropDuplicates(["doc_id", "key", "items", "spans"]).groupBy(F.col("doc_id").alias("id_"), F.col("key").alias("key_")).agg(F.flatten(F.collect_list("items")).alias("items_"), F.flatten(F.collect_list("spans")).alias("spans_"))
        rows = rows.join(rest.hint("merge"), F.expr("key = key_ and doc_id <=> id_"), "left")
        rows = rows.selectExpr("doc_id", "key", "n_words", "array_sort(array_distinct(concat(items, coalesce(items_, array())))) as items", f"{_merged('concat(spans, coalesce(spans_, array()))')} as spans")
    return rows.selectExpr("doc_id", "n_words", "aggregate(spans, 0L, (s, x) -> s + x.b - x.a) as n_hit", "items", "spans")


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    out = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, most: int = MAX_WORDS) -> DataFrame:
    """docs, all columns, without contaminated documents. Only rows that may go are shuffled (common.near)."""
    first, more = _hits(docs, benchmark, most, False)
    for x in more:
        first = first.unionByName(x)
    bad = materialize(first.select(F.col("doc_id").alias("id of a hit"), F.col("key").alias("key of a hit")).distinct(), "contaminated")
    name = {c.lower(): f"`{c}`" for c in docs.columns}
    key, ident = f"xxhash64(try_cast({name['doc_id']} as long), cast({name['text']} as string))", f"try_cast({name['doc_id']} as long)"
    some, rest = near(docs, F.expr(key), bad.selectExpr("`key of a hit` as key"))
    return some.join(bad.hint("merge"), F.expr(f"{key} = `key of a hit` and {ident} <=> `id of a hit`"), "left_anti").unionByName(rest)


SQL5 = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
k as (select item_id, least(len(w), 10) as k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as g from (select *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0)),
s as (select distinct k from k),
g as (select doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') as g from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from d, s where len(w) >= k)),
h as (select distinct g.doc_id, g.i, g.k, k.item_id from g join k on k.g = g.g and k.k = g.k),
p as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from h) group by 1),
m as (select doc_id, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as ids from (select distinct doc_id, item_id from h) group by 1)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join p on p.doc_id = d.doc_id left join m on m.doc_id = d.doc_id"""

QUERIES = {"op5_decontaminate": op5_decontaminate}
SQL = {"op5_decontaminate": SQL5}
