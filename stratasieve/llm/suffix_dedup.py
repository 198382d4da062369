"""Repeated passages by sparse suffix arrays.

A passage is a run of PASSAGE words that occurs at least twice (white space between words does not count). Of all suffixes
only those at minimiser positions are kept: in each run of PASSAGE words, the first place whose next SEED words have
the least hash. The place depends on the run's content alone, so equal runs keep equal suffixes, about two in
PASSAGE - SEED words; a suffix stands for the runs that chose it, and its cover is all their words, left and right of it.

Suffixes whose SEED words stand nowhere else go first, by an aggregate. Of suffixes with equal covers, a class, one goes on with
their number and first place, again by an aggregate, so a passage in a third of all documents costs no more than another. Seeds with one class need no
more: its runs all repeat. The others are put in the order of their words by a range-partitioned sort (words compare by their hashes,
SEED words first, then word by word to the right), in which a hot seed's suffixes are split by what follows. Each is
compared with its two neighbours: the longer common prefix is the furthest that any suffix agrees to the right, so runs that would need more
are settled there. (At the edges of a partition the neighbour isn't known and nothing is settled.) From there the match is extended to the left: a run whose words right of the suffix agree with a
neighbour's is looked for by all its words, and repeats if another suffix's run has the same.

Occurrences are ordered by (doc_id, nulls last; then a hash of id and text; then place). The first of a run's occurrences
stays; words of any later one are `removed`, words of any repeated run are `repeated`.

Words agree where their 64-bit hashes do (bytetext); a run must agree in the hashes of its seed, its place and all its words.

Texts are read twice: for the suffixes, and again, after a filter of bounded size (common.near), those with suffixes that are sorted. The plan is the same at
every size.

Defined cases: null, empty and short texts (under PASSAGE words) have no runs. Rows that repeat id and text are one
document here and get the same spans. Repeats inside one document count. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as bt
from .common import columns, components, materialize, near, release

PASSAGE = 50
SEED = 20
SPAN = PASSAGE - SEED + 1  # places of the seed in a run; bits of a mask
_PLACE = "named_struct('last', doc_id is null, 'doc_id', doc_id, 'key', key, 'at', {})"
_SPANS = "array<struct<a:long,b:long>>"


def minimisers(w: bt.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Kept places, first and last run that each stands for, and the seed's hash."""
    at, g = w.grams(SEED)
    none = np.zeros(0, np.int64)
    if len(g) < SPAN:
        return none, none, none, g[:0]
    val, idx, width = g, np.arange(len(g)), 1
    for step in (1, 2, 4, 8, SPAN - 16):
        n = len(val) - step
        later = val[step:] < val[:n]  # ties: the first
        val, idx = np.where(later, val[step:], val[:n]), np.where(later, idx[step:], idx[:n])
        width += step
    assert width == SPAN
    ok = np.flatnonzero(at[: len(val)] + PASSAGE <= w.first[1:][w.doc[at[: len(val)]]])
    if not len(ok):
        return none, none, none, g[:0]
    m, s = idx[ok], at[ok]
    new = np.flatnonzero(np.concatenate(([True], m[1:] != m[:-1])))
    end = np.append(new[1:], len(m)) - 1
    return at[m[new]], s[new], s[end], g[m[new]]


def _keyed(docs: DataFrame) -> DataFrame:
    return columns(docs, doc_id="long", text="string").withColumn("key", F.xxhash64("doc_id", "text"))


def suffixes(keyed: DataFrame) -> DataFrame:
    """doc_id, key, p (place of a kept suffix), s0, s1 (first and last run it stands for), g (hash of the seed), c (hash of all words of the runs); and for each row p = -1 with its number of words in c."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc_id, key = b["doc_id"], b["key"]
            for i, j, t in bt.slices(b["text"]):
                w = t.words(bt.NOT_SPACE, False)
                p, s0, s1, g = minimisers(w)
                c = bt.join(w.runs(s0, s1 + PASSAGE), (p - s0).astype(np.uint64))
                d = w.doc[p]
                first = w.first[d]
                take = pa.array(np.concatenate((np.arange(i, j), i + d)))
                own = np.full(t.n, -1, np.int64)
                col = lambda x, head: pa.array(np.concatenate((head, x)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([doc_id.take(take), key.take(take), col(p - first, own), col(s0 - first, own), col(s1 - first, own), pa.array(np.concatenate((own, g.view(np.int64)))), pa.array(np.concatenate((w.count.astype(np.int64), c.view(np.int64))))], ["doc_id", "key", "p", "s0", "s1", "g", "c"])

    return keyed.mapInArrow(keep, "doc_id long, key long, p int, s0 int, s1 int, g long, c long")


def _same(doc_id: str = "doc_id_", key: str = "key_"):
    return F.expr(f"key = `{key}` and doc_id <=> `{doc_id}`")


def _sorted_suffixes(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted suffixes, one of each class, in the order of their words: g, right (hashes of the words after the seed, as far as runs go, most significant byte first), c, n, doc_id, key, p, s0, s1 and h, the hashes of its runs."""
    lists = materialize(wanted.groupBy("doc_id", "key").agg(F.collect_list(F.struct("g", "c", "n", "p", "s0", "s1")).alias("list")), "wanted")  # as long as a text's suffixes at most
    rows, _ = near(keyed, F.col("key"), lists)
    rows = rows.join(lists.selectExpr("doc_id as doc_id_", "key as key_", "list").hint("merge"), _same()).select("doc_id", "key", "text", "list")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, t in bt.slices(b["text"]):
                w = t.words(bt.NOT_SPACE, False)
                lists = b["list"].slice(i, j - i)
                x = lists.flatten()
                f = {k: x.field(k).to_numpy(zero_copy_only=False) for k in ("g", "c", "n", "p", "s0", "s1")}
                doc = np.repeat(np.arange(j - i), np.asarray(pc.list_value_length(lists)))
                base, p, s0, s1 = w.first[doc], *[f[k].astype(np.int64) for k in ("p", "s0", "s1")]
                many = s1 - s0 + 1
                r = np.repeat(np.arange(len(many)), many)
                s = np.arange(len(r)) - np.repeat(np.cumsum(many) - many, many) + s0[r]
                h = w.runs(base[r] + s, base[r] + s + PASSAGE)
                size = s1 + PASSAGE - p - SEED  # words after the seed that some run has
                r2 = np.repeat(np.arange(len(size)), size)
                right = w.hash[(base + p + SEED)[r2] + np.arange(len(r2)) - np.repeat(np.cumsum(size) - size, size)]
                off = np.concatenate(([0], np.cumsum(4 * size))).astype(np.int32)
                words = pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(off.tobytes()), pa.py_buffer((right >> np.uint64(32)).astype(">u4").tobytes())])
                runs = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(many))).astype(np.int32)), pa.array(h.view(np.int64)))
                take = pa.array(i + doc)
                yield pa.RecordBatch.from_arrays([pa.array(f["g"]), words, pa.array(f["c"]), pa.array(f["n"]), b["doc_id"].take(take), b["key"].take(take), pa.array(p.astype(np.int32)), pa.array(s0.astype(np.int32)), pa.array(s1.astype(np.int32)), runs], ["g", "right", "c", "n", "doc_id", "key", "p", "s0", "s1", "h"])

    got = rows.mapInArrow(read, "g long, right binary, c long, n long, doc_id long, key long, p int, s0 int, s1 int, h array<long>")
    order = ["g", "right", "c", "key"]
    return got.repartitionByRange(*order).sortWithinPartitions(*order)


def common_prefix(right: pa.Array) -> np.ndarray:
    """Words after the seed in which each suffix agrees with the one after it (one less than the suffixes)."""
    size = np.asarray(pc.binary_length(right)).astype(np.int64) // 4
    off = np.cumsum(size) - size
    words = np.frombuffer(b"".join(right.to_pylist()), ">u4")
    out = np.zeros(max(len(size) - 1, 0), np.int64)
    live = np.arange(len(out))
    for k in range(PASSAGE - SEED):
        live = live[(size[live] > k) & (size[live + 1] > k)]
        live = live[words[off[live] + k] == words[off[live + 1] + k]]
        if not len(live):
            break
        out[live] = k + 1
    return out


def _candidates(ordered: DataFrame) -> DataFrame:
    """The runs that may repeat, extended left and right of their suffixes: g, c, n, bit (the suffix's place in the run), h and the run's place s."""

    def extend(b: pa.RecordBatch, before: np.ndarray, known: np.ndarray) -> pa.RecordBatch:
        """before: words after the seed shared with either neighbour; known: whether both are known."""
        f = {k: b[k].to_numpy(zero_copy_only=False) for k in ("g", "c", "n", "p", "s0", "s1")}
        p, s0, s1 = (f[k].astype(np.int64) for k in ("p", "s0", "s1"))
        many = s1 - s0 + 1
        r = np.repeat(np.arange(len(many)), many)
        s = np.arange(len(r)) - np.repeat(np.cumsum(many) - many, many) + s0[r]
        h = np.asarray(b["h"].flatten())
        # a run needs its words right of the suffix in common with some suffix, and none has more than a neighbour; a class of several repeats by itself
        may = (f["n"][r] > 1) | ~known[r] | (SEED + before[r] >= s + PASSAGE - p[r])
        r, s, h = r[may], s[may], h[may]
        take = pa.array(r)
        return pa.RecordBatch.from_arrays([pa.array(f["g"][r]), pa.array(f["c"][r]), pa.array(f["n"][r]), pa.array((p[r] - s).astype(np.int32)), pa.array(h), b["doc_id"].take(take), b["key"].take(take), pa.array(s.astype(np.int32))], ["g", "c", "n", "bit", "h", "doc_id", "key", "s"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ahead, first = None, 0, True  # the last row of the batch before, what it shares with the one before it, whether that is unknown
        for b in batches:
            if not b.num_rows:
                continue
            t = b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            g = t["g"].to_numpy()
            same = np.where(g[1:] == g[:-1], common_prefix(t["right"]), -SEED)
            n = t.num_rows
            up, down = np.concatenate(([ahead], same)), np.append(same, 0)
            known = np.ones(n, bool)
            known[0] = not first
            if n > 1:
                yield extend(t.slice(0, n - 1), np.maximum(up, down)[:-1], known[:-1])
                first = False
            held, ahead = t.slice(n - 1), up[-1]
        if held is not None:
            yield extend(held, np.array([ahead]), np.zeros(1, bool))

    return ordered.mapInArrow(compare, "g long, c long, n long, bit int, h long, doc_id long, key long, s int")


def spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, n_words, a row for each row of docs; doc_id, key, repeated and removed: arrays of word spans a, b, and holders, the ids of other documents that have its passages first: one row for each document that has any)."""
    keyed = _keyed(docs)
    kept = materialize(suffixes(keyed), "suffixes")
    counts = materialize(kept.where("p < 0").selectExpr("doc_id", "key", "c as n_words"), "counts")
    own = kept.where("p >= 0")
    # rows that repeat id and text are one document
    twice = counts.groupBy("doc_id", "key").agg(F.count("*").alias("n")).where("n > 1")
    if not twice.isEmpty():
        own = own.distinct()
    groups = materialize(own.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g"), "groups")
    own = materialize(own.join(groups.hint("merge"), "g"), "repeated")
    release(kept, groups)
    classes = materialize(own.groupBy("g", "c").agg(F.count("*").alias("n"), F.min(F.expr(_PLACE.format("p").replace("'at', p", "'at', p, 's0', s0, 's1', s1"))).alias("first")), "classes")
    several = materialize(classes.groupBy("g").agg(F.count("*").alias("k")).where("k > 1").select("g"), "several")
    wanted = classes.join(several.hint("merge"), "g").selectExpr("g", "c", "n", "first.doc_id", "first.key", "first.at as p", "first.s0", "first.s1")
    runs = materialize(_candidates(_sorted_suffixes(keyed, wanted)), "runs")
    place, run = F.expr(_PLACE.format("s")), ["g", "bit", "h"]
    again = materialize(runs.groupBy(*run).agg(F.sum("n").alias("total"), F.min(place).alias("first")).where("total > 1").select(*run, "first"), "again")
    hit = runs.join(again.hint("merge"), run).withColumn("own", F.expr(_PLACE.format("s") + " = first"))
    partly = hit.groupBy("g", "c").agg(F.sum(F.expr("shiftleft(1L, bit)")).alias("mask"), F.sum(F.expr("case when own then 0L else shiftleft(1L, bit) end")).alias("first_mask"), F.collect_set("first.doc_id").alias("holders"))  # SPAN holders at most
    whole = classes.join(several.hint("merge"), "g", "left_anti").selectExpr("g", "c", "shiftleft(1L, int(first.at - first.s0) + 1) - shiftleft(1L, int(first.at - first.s1)) as mask", "0L as first_mask", "filter(array(first.doc_id), x -> x is not null) as holders", "n").where("n > 1").drop("n")
    masks = materialize(whole.unionByName(partly).join(classes.select("g", "c", "first").hint("merge"), ["g", "c"]), "masks")
    found = own.join(masks.hint("merge"), ["g", "c"]).withColumn("gone", F.expr("case when p = first.at and key = first.key and doc_id <=> first.doc_id then first_mask else mask end"))
    found = found.groupBy("doc_id", "key").agg(F.collect_list(F.struct("p", "mask", "gone", "holders")).alias("list"))  # as long as a text's suffixes at most

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
        for b in batches:
            out = {"mask": [], "gone": []}
            holders = []
            for i, x in enumerate(b["list"]):
                x = x.values
                p = x.field("p").to_numpy(zero_copy_only=False).astype(np.int64)
                for k, got in out.items():
                    m = x.field(k).to_numpy(zero_copy_only=False)
                    s = np.unique(np.concatenate([p[(m >> bit) & 1 == 1] - bit for bit in range(SPAN)]))
                    cut = np.flatnonzero(np.diff(s) > PASSAGE)
                    a, e = (s[np.concatenate(([0], cut + 1))], s[np.append(cut, len(s) - 1)] + PASSAGE) if len(s) else (s, s)
                    got.append([{"a": int(u), "b": int(v)} for u, v in zip(a, e)])
                ids = np.unique(x.field("holders").flatten().to_numpy(zero_copy_only=False))
                own = b["doc_id"][i].as_py()
                holders.append([] if own is None else [int(h) for h in ids if h != own])
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["key"], pa.array(out["mask"], kind), pa.array(out["gone"], kind), pa.array(holders, pa.list_(pa.int64()))], ["doc_id", "key", "repeated", "removed", "holders"])

    spans_ = materialize(found.mapInArrow(decode, f"doc_id long, key long, repeated {_SPANS}, removed {_SPANS}, holders array<long>"), "spans")
    release(own, classes, several, runs, again, masks)
    return counts, spans_


def repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, component_id, n_links, n_words, n_repeated and n_removed (words), repeated and removed (spans of words) of every row.

    A passage links each document that has it with the one that has it first: n_links counts a document's links, component_id is the least
    doc_id that links reach (its own without links; null for a null id).
    """
    counts, found = spans(docs)
    links = materialize(found.select(F.col("doc_id").alias("a"), F.explode("holders").alias("b")).distinct(), "links")
    number = links.selectExpr("a as id").union(links.selectExpr("b")).groupBy("id").agg(F.count("*").alias("n_links"))
    linked = materialize(components(links).join(number.withColumnRenamed("id", "node").hint("merge"), "node"), "linked")
    release(links)
    none = F.expr("cast(array() as array<struct<a:bigint,b:bigint>>)")
    out = counts.join(found.selectExpr("doc_id as doc_id_", "key as key_", "repeated", "removed").hint("merge"), _same(), "left")
    out = out.join(linked.hint("merge"), F.expr("doc_id = node"), "left").withColumn("component_id", F.coalesce("component", "doc_id")).withColumn("n_links", F.coalesce("n_links", F.lit(0)))
    out = out.select("doc_id", "component_id", "n_links", "n_words", F.coalesce("repeated", none).alias("repeated"), F.coalesce("removed", none).alias("removed"))
    words = "aggregate({}, 0L, (n, x) -> n + x.b - x.a)"
    return out.select("doc_id", "component_id", "n_links", "n_words", F.expr(words.format("repeated")).alias("n_repeated"), F.expr(words.format("removed")).alias("n_removed"), "repeated", "removed")


def cut_repeats(docs: DataFrame) -> DataFrame:
    """docs, all columns, with `removed` passages cut from the texts (n_chars, if there, follows); a document of which no word is left goes.

    Only texts that may be cut (common.near) are shuffled.
    """
    counts, found = spans(docs)
    gone = materialize(found.where("size(removed) > 0").selectExpr("doc_id as `cut id`", "key as `cut key`", "removed as `cut spans`"), "cut")
    release(counts, found)
    name = {c.lower(): c for c in docs.columns}
    text, ident = f"`{name['text']}`", f"`{name['doc_id']}`"
    hashed = f"xxhash64(try_cast({ident} as long), cast({text} as string))"
    d, rest = near(docs, F.expr(hashed), gone.selectExpr("`cut key` as key"))
    d = d.join(gone.hint("merge"), F.expr(f"{hashed} = `cut key` and try_cast({ident} as long) <=> `cut id`"), "left").drop("cut id", "cut key")
    schema = docs.schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, keep = b[name["text"]].to_pylist(), np.ones(b.num_rows, bool)
            sizes = b[name["n_chars"]].to_pylist() if "n_chars" in name else []
            for i, x in enumerate(b["cut spans"]):
                if not x.is_valid or texts[i] is None:
                    continue
                raw = texts[i].encode("utf-8", "surrogatepass")
                w = bt.one([texts[i]]).words(bt.NOT_SPACE, False, False)
                parts, at = [], 0
                for s in x.as_py():
                    parts.append(raw[at : w.start[s["a"]]])
                    at = w.start[s["b"]] if s["b"] < len(w.start) else len(raw)
                texts[i] = b"".join([*parts, raw[at:]]).decode("utf-8", "surrogatepass")
                keep[i] = bool(texts[i].strip(" \t\n\x0b\x0c\r"))
                if sizes:
                    sizes[i] = len(texts[i])
            got = [pa.array(texts, b[c].type) if c == name["text"] else pa.array(sizes, b[c].type) if sizes and c == name["n_chars"] else b[c] for c in schema.names]
            yield pa.RecordBatch.from_arrays(got, names=schema.names).filter(pa.array(keep))

    return d.mapInArrow(cut, schema).unionByName(rest)


def op8_repeated_passages(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("repeated", "removed")


QUERIES = {"op8_repeated_passages": op8_repeated_passages}
#: runs of 50 words by text; first occurrence by document and place
SQL = {
    "op8_repeated_passages": r"""
with recursive d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
r as (select doc_id, i, hash(array_to_string(w[i + 1:i + 50], ' ')) as h from (select doc_id, w, unnest(range(0, len(w) - 49)) as i from d where len(w) >= 50)),
c as (select *, count(*) over (partition by h) as n, row_number() over (partition by h order by doc_id, i) as k from r),
m as (select doc_id, i, k > 1 as later from c where n > 1),
e as (select distinct doc_id as a, b from (select doc_id, first_value(doc_id) over (partition by h order by doc_id, i) as b from c where n > 1) where doc_id <> b),
z as (select a as u, b as v from e union select b, a from e),
t(u, v) as (select u, v from z union select t.u, z.v from t join z on z.u = t.v),
q as (select u, least(u, min(v)) as c from t group by u),
ln as (select u, count(*) as n from (select a as u from e union all select b from e) group by 1),
o as (select *, case when i - lag(i) over (partition by doc_id order by i) <= 50 then 0 else 1 end as new from m),
s as (select doc_id, part, min(i) as a, max(i) + 50 as b from (select *, sum(new) over (partition by doc_id order by i) as part from o) group by 1, 2),
o2 as (select *, case when i - lag(i) over (partition by doc_id order by i) <= 50 then 0 else 1 end as new2 from m where later),
s2 as (select doc_id, part, min(i) as a, max(i) + 50 as b from (select *, sum(new2) over (partition by doc_id order by i) as part from o2) group by 1, 2),
x as (select doc_id, sum(b - a)::bigint as n, list({'a': a::bigint, 'b': b::bigint} order by a) as l from s group by 1),
y as (select doc_id, sum(b - a)::bigint as n, list({'a': a::bigint, 'b': b::bigint} order by a) as l from s2 group by 1)
select d.doc_id, coalesce(q.c, d.doc_id) as component_id, coalesce(ln.n, 0)::bigint as n_links, len(w)::bigint as n_words, coalesce(x.n, 0)::bigint as n_repeated, coalesce(y.n, 0)::bigint as n_removed
from d left join x on x.doc_id = d.doc_id left join y on y.doc_id = d.doc_id left join q on q.u = d.doc_id left join ln on ln.u = d.doc_id"""
}
