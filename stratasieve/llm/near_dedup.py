"""MinHash near-duplicates with sequential Bayesian verification.

A document's set is its distinct SHINGLE-word shingles (fewer words: the whole sequence). Documents of equal
sets (by size and 128 bits of two independent hashes) are one class, found by an aggregate, and only the text of one of them goes on. A class's signature is
VALUES minima in BANDS bands; two classes at the threshold miss each other in all bands with probability
(1 - T^ROWS)^BANDS, 4e-7 for the defaults. Candidates are classes that share a bucket, a band's values.

First each bucket's members are compared with its least member. Then, in buckets whose members still are of several components, those
outside the bucket's largest one are compared with all others, in blocks of BLOCK members that hold signatures only; a pair belongs to the first of its common bands, so it is compared
once. Each time signatures are compared batch by batch and a pair
is pruned once the posterior probability of T or more (uniform prior) falls under MISS; survivors are verified word by word on their
whole texts. A block with more than DENSE survivors for each of its members gives a forest of them, likeliest first; where that leaves its bucket in several
components, the bucket's members are compared in blocks that hold the texts (TEXT_BLOCK shingles at most, or one text), and a pair is verified there unless a link found before joins it.
So rows grow with the members of buckets, and a component needs only links that join it; every other candidate pair is
tested. Links become forests, by tasks of about LINKS links each, before stars are contracted over what these leave. No list of pairs, links or components is ever on the driver.

Defined cases: null or empty texts have no shingles, n_shingles 0, and are linked with nothing. Rows are told apart by id and text: repeated
rows are of one class, and rows of one id with different texts are each judged by their own. A null doc_id is
linked with nothing: component_id null, kept true. Equal sets in different orders are one class. An
empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytetext as bt
from .common import columns, components, materialize, near, release

SHINGLE = 5
BANDS, ROWS = 20, 4
VALUES = BANDS * ROWS
BATCH = 16
MISS = 1e-6
#: members of a bucket in a block, where signatures are compared; shingles, where texts are
BLOCK, TEXT_BLOCK = 4096, 200_000
#: survivors for each member of a block, above which only a forest of them is emitted
DENSE = 8
#: links that a task makes a forest of, before components are found
LINKS = 1 << 18
#: pairs whose signatures are compared in one step of a task
STEP = 1 << 15
_rng = np.random.Generator(np.random.PCG64(20240229))
_XOR = _rng.integers(0, 1 << 63, VALUES, dtype=np.uint64)
_MUL = _rng.integers(0, 1 << 63, VALUES, dtype=np.uint64) | np.uint64(1)


def least_matches(threshold: float, miss: float = MISS) -> list[tuple[int, int]]:
    """(values compared, matches that a pair must have so far): with fewer, P(similarity >= threshold) < miss."""
    out = []
    for t in range(BATCH, VALUES + 1, BATCH):
        p, m = 0.0, 0
        while m <= t:
            p += comb(t + 1, m) * threshold**m * (1 - threshold) ** (t + 1 - m)
            if p >= miss:
                break
            m += 1
        out.append((t, m))
    return out


def shingle_sets(t: bt.Texts, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, hash of another kind) of each distinct shingle, by text and hash."""
    w = t.words(bt.NOT_SPACE, True)
    at = w.starts(k)
    short = np.flatnonzero((w.count > 0) & (w.count < k))
    begin, end = np.concatenate((at, w.first[short])), np.concatenate((at + k, w.first[short + 1]))
    doc = np.concatenate((w.doc[at], short))
    h = w.runs(begin, end)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    rows = order[new]
    return doc[new], h[new], w.other(1).runs(begin[rows], end[rows])


def _digests(doc: np.ndarray, hashes: tuple[np.ndarray, np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set size and two 64-bit sums that name a set, by text."""
    at = np.searchsorted(doc, np.arange(n + 1))
    sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(bt.mix(h ^ np.uint64(0x5851F42D4C957F2D))))) for h in hashes]
    return np.diff(at), *[(x[at[1:]] - x[at[:-1]]).view(np.int64) for x in sums]


def _key() -> Column:
    return F.xxhash64(F.col("doc_id").try_cast("long"), F.col("text").cast("string"))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, key (hash of id and text), n (set size), s1 and s2 (the set's name) and sig (VALUES 32-bit minima; empty without shingles)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, t in bt.slices(b["text"]):
                doc, h, h2 = shingle_sets(t)
                n, s1, s2 = _digests(doc, (h, h2), t.n)
                some = np.flatnonzero(n)
                sig = np.zeros((len(some), VALUES), np.uint32)
                if len(some):
                    at = np.searchsorted(doc, some)
                    for k in range(VALUES):
                        sig[:, k] = np.minimum.reduceat(((h ^ _XOR[k]) * _MUL[k]) >> np.uint64(32), at)
                off = np.zeros(t.n + 1, np.int32)
                np.cumsum((n > 0) * 4 * VALUES, out=off[1:])
                sigs = pa.BinaryArray.from_buffers(pa.binary(), t.n, [None, pa.py_buffer(off.tobytes()), pa.py_buffer(sig.tobytes())])
                yield pa.RecordBatch.from_arrays([b["doc_id"].slice(i, j - i), b["key"].slice(i, j - i), pa.array(n, pa.int64()), pa.array(s1), pa.array(s2), sigs], ["doc_id", "key", "n", "s1", "s2", "sig"])

    return columns(docs, doc_id="long", text="string").withColumn("key", _key()).mapInArrow(sketch, "doc_id long, key long, n long, s1 long, s2 long, sig binary")


def _matrix(sig: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sig.to_pylist()), np.uint32).reshape(len(sig), VALUES)


def _bands(classes: DataFrame) -> DataFrame:
    """node, n (set size), and the band and name of each of its buckets."""

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            m = _matrix(b["sig"]).astype(np.uint64)
            names = np.empty((len(m), BANDS), np.uint64)
            for k in range(BANDS):
                x = np.full(len(m), k + 1, np.uint64)
                for r in range(ROWS):
                    x = bt.mix(x * np.uint64(0x9E3779B97F4A7C15) ^ m[:, k * ROWS + r])
                names[:, k] = x
            node, n = (np.repeat(np.asarray(b[c]), BANDS) for c in ("node", "n"))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(n), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(m))), pa.array(names.reshape(-1).view(np.int64))], ["node", "n", "band", "b"])

    return classes.select("node", "n", "sig").mapInArrow(bands, "node long, n long, band int, b long")


def _survivors(x: np.ndarray, y: np.ndarray, rows: np.ndarray, cols: np.ndarray, need: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs x[rows], y[cols] of signatures are not ruled out by a sequential comparison, and their matches."""
    alive, m, seen = np.arange(len(rows)), np.zeros(len(rows), np.int64), 0
    for t, least in need:
        m = m + (x[rows[alive], seen:t] == y[cols[alive], seen:t]).sum(1)
        ok = m >= least
        alive, m, seen = alive[ok], m[ok], t
    return alive, m


def _prune(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs a, b that sequential comparison of the signatures doesn't rule out."""
    need = least_matches(percent / 100)
    c = classes.select("node", "n", "sig")
    left, right = (c.withColumnsRenamed({"node": x, "n": f"n{x}", "sig": f"sig{x}"}) for x in "ab")
    p = pairs.join(right.hint("merge"), "b").join(left.hint("merge"), "a").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            every = np.arange(batch.num_rows)
            alive, _ = _survivors(_matrix(batch["siga"]), _matrix(batch["sigb"]), every, every, need)
            yield pa.RecordBatch.from_arrays([batch["a"].take(pa.array(alive)), batch["b"].take(pa.array(alive))], ["a", "b"])

    return p.select("a", "b", "siga", "sigb").mapInArrow(prune, "a long, b long")


def _texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and text of the classes named by nodes; other texts are not shuffled (common.near)."""
    d = columns(docs, doc_id="long", text="string").select(_key().alias("node"), "text")
    d, _ = near(d, F.col("node"), nodes.selectExpr("node as key"))
    return d.join(nodes.hint("merge"), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))  # rows of a node repeat id and text


def exact_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, code) of each distinct shingle, by text; codes are equal only for equal words."""
    (_, _, t), *_ = bt.slices(texts, 1 << 62)
    doc, code = t.words(bt.NOT_SPACE, True, False).exact_runs(SHINGLE)
    most = int(code.max(initial=0)) + 1
    both = np.unique(doc * most + code)
    return both // most, both % most


def similar(x: pa.Array, y: pa.Array, percent: int) -> np.ndarray:
    """Whether the sets of x[i] and y[i] are similar enough, word by word."""
    ok = np.zeros(len(x), bool)
    upto = np.cumsum(np.asarray(pc.binary_length(x)).astype(np.int64) + np.asarray(pc.binary_length(y)))
    i = 0
    while i < len(x):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + bt.SLICE_BYTES, "right")))
        m = j - i
        doc, code = exact_sets(pa.concat_arrays([x.slice(i, m), y.slice(i, m)]))
        n = np.bincount(doc, minlength=2 * m)
        pair = np.sort(doc % m * (int(code.max(initial=0)) + 1) + code)
        same = np.bincount(pair[1:][pair[1:] == pair[:-1]] // (int(code.max(initial=0)) + 1), minlength=m)
        ok[i:j] = 100 * same >= percent * (n[:m] + n[m:] - same)
        i = j
    return ok


def _verify(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs a, b whose whole texts have the similarity."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(similar(batch["x"], batch["y"], percent)))

    p = pairs.join(texts.selectExpr("node as b", "text as y").hint("merge"), "b").join(texts.selectExpr("node as a", "text as x").hint("merge"), "a")
    return p.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long")


def _blocks(members: DataFrame, labels: DataFrame, load: str, most: int) -> DataFrame:
    """Members of buckets that hold several components, dealt into pairs of blocks i <= j: bucket, i, j, node, band, c (component), out (outside the bucket's largest component) and k, the member's block.

    A member stands in as many pairs of blocks as its bucket has blocks of about `most` of load (SQL: 1 for members, n for shingles).
    """
    m = members.join(labels.selectExpr("node", "component").hint("merge"), "node", "left").selectExpr("b as bucket", "band", "node", "n", "coalesce(component, node) as c")
    m = materialize(m, "labelled")
    sizes = m.groupBy("bucket", "c").agg(F.count("*").alias("rows"), F.expr(f"sum({load})").alias("load"))
    opened = sizes.groupBy("bucket").agg(F.sum("load").alias("load"), F.count("*").alias("parts"), F.max(F.struct("rows", "c")).alias("home")).where("parts > 1")
    opened = materialize(opened.selectExpr("bucket", f"(load + {most - 1}) div {most} as blocks", "home.c as home"), "open")
    m = m.join(opened.hint("merge"), "bucket").selectExpr("bucket", "band", "node", "c", "c <> home as out", "blocks", "pmod(xxhash64(node), blocks) as k")
    m = m.selectExpr("*", "explode(sequence(0L, blocks - 1)) as other")
    return m.selectExpr("bucket", "least(k, other) as i", "greatest(k, other) as j", "node", "band", "c", "out", "k")


def _first_band(sig: np.ndarray, x: np.ndarray, y: np.ndarray, band: np.ndarray) -> np.ndarray:
    """Whether the pairs have no common band before `band`."""
    ok = np.ones(len(x), bool)
    for k in range(int(band.max(initial=0))):
        rows = np.flatnonzero(ok & (band > k))
        ok[rows] = (sig[x[rows], k * ROWS : (k + 1) * ROWS] != sig[y[rows], k * ROWS : (k + 1) * ROWS]).any(1)
    return ok


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by bucket, i and j: tables of whole pairs of blocks, and where each begins (the end of the last included)."""
    held: list[pa.RecordBatch] = []

    def cut(t: pa.Table, last: bool) -> tuple[pa.Table, np.ndarray, pa.Table]:
        key = np.stack([t[c].to_numpy() for c in ("bucket", "i", "j")])
        new = np.concatenate(([0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1))
        end = t.num_rows if last else int(new[-1])
        return t.slice(0, end), np.append(new[new < end], end), t.slice(end)

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        if all(held[0][c][0] == b[c][b.num_rows - 1] for c in ("bucket", "i", "j")):
            continue
        t, at, rest = cut(pa.Table.from_batches(held), False)
        yield t.combine_chunks(), at
        held = rest.to_batches()
    if held:
        t, at, _ = cut(pa.Table.from_batches(held), True)
        yield t.combine_chunks(), at


class _Forest:
    """Components of a few numbers."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (up := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(up, up)
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether they were apart."""
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


_DEALT = ["bucket", "i", "j"]


_PAIRED = ["bucket", "i", "j", "k"]


class _Group:
    """Survivors of one pair of blocks: all of them, or a forest once they are more than DENSE for each row."""

    def __init__(self, c: np.ndarray) -> None:
        self.label, self.dense, self.n, self.kept = c.copy(), False, 0, []

    def add(self, x: np.ndarray, y: np.ndarray, m: np.ndarray) -> None:
        self.n += len(x)
        self.kept.append((x, y, m))
        if self.dense or self.n > DENSE * len(self.label):
            parts = self.kept if not self.dense else self.kept[-1:]
            done = [] if not self.dense else self.kept[:-1]
            self.dense = True
            x, y, m = (np.concatenate(z) for z in zip(*parts))
            order, at = np.argsort(-m, kind="stable"), []
            x, y, m = x[order], y[order], m[order]
            left = np.flatnonzero(self.label[x] != self.label[y])
            while len(left):  # as often as components join: fewer times than there are rows
                at.append(left[0])
                a, b = self.label[x[left[0]]], self.label[y[left[0]]]
                self.label[self.label == b] = a
                left = left[self.label[x[left]] != self.label[y[left]]]
            self.kept = [*done, (x[at], y[at], m[at])]


def _across(blocks: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs a, b of different components that share a bucket and whose signatures survive; and bucket, of blocks that emit a forest only."""
    need = least_matches(percent / 100)
    rows = blocks.join(classes.select("node", "n", "sig").hint("merge"), "node").repartition(*_DEALT).sortWithinPartitions(*_PAIRED)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in _groups(batches):
            i, j, k, node, band, c, n, out = (np.asarray(t[x].combine_chunks()) for x in ("i", "j", "k", "node", "band", "c", "n", "out"))
            sig = _matrix(t["sig"].combine_chunks())
            group = np.repeat(np.arange(len(at) - 1), np.diff(at))
            first = np.bincount(group[k == i], minlength=len(at) - 1)  # rows of the first block of each group, which stand first
            # who is outside the largest component is compared with the other block, or with all of its own
            left = np.flatnonzero(out)
            g = group[left]
            alone, low = i[left] == j[left], k[left] == i[left]
            begin = np.where(alone | ~low, at[g], at[g] + first[g])
            many = np.where(alone | low, at[g + 1], at[g] + first[g]) - begin
            upto, found = np.cumsum(many), {}
            a = 0
            while a < len(left):
                b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + STEP, "right")))
                size = many[a:b]
                x = np.repeat(left[a:b], size)
                y = np.arange(len(x)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin[a:b], size)
                ok = (c[x] != c[y]) & (~out[y] | (node[x] < node[y])) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
                x, y = x[ok], y[ok]
                alive, m = _survivors(sig, sig, x, y, need)
                x, y = x[alive], y[alive]
                own = _first_band(sig, x, y, band[x])
                x, y, m = x[own], y[own], m[own]
                cut = np.flatnonzero(np.diff(group[x])) + 1
                for rx, ry, rm in zip(np.split(x, cut), np.split(y, cut), np.split(m, cut)):
                    if len(rx):
                        q = int(group[rx[0]])
                        if q not in found:
                            found[q] = _Group(c[at[q] : at[q + 1]])
                        found[q].add(rx - at[q], ry - at[q], rm)
                a = b
            if not found:
                continue
            x = np.concatenate([z[0] + at[q] for q, f in found.items() for z in f.kept])
            y = np.concatenate([z[1] + at[q] for q, f in found.items() for z in f.kept])
            bucket = np.asarray(t["bucket"].combine_chunks())[at[[q for q, f in found.items() if f.dense]]]
            pairs, dense = len(x), len(bucket)
            none = lambda size: np.zeros(size, np.int64)
            of_bucket = np.arange(pairs + dense) >= pairs
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((node[x], none(dense))), mask=of_bucket), pa.array(np.concatenate((node[y], none(dense))), mask=of_bucket), pa.array(np.concatenate((none(pairs), bucket)), mask=~of_bucket)], ["a", "b", "bucket"])

    return rows.select(*_PAIRED, "node", "band", "c", "out", "n", "sig").mapInArrow(compare, "a long, b long, bucket long")


def _within(blocks: DataFrame, classes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links a, b between different components of dense buckets, verified in blocks that hold the texts."""
    need = least_matches(percent / 100)
    rows = blocks.join(classes.select("node", "n", "sig").hint("merge"), "node").join(texts.hint("merge"), "node").repartition(*_DEALT).sortWithinPartitions(*_PAIRED)

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in _groups(batches):
            a, b = [], []
            for u, v in zip(at[:-1], at[1:]):
                g = t.slice(u, v - u).combine_chunks()
                i, j, k, node, band, c, n, out = (np.asarray(g[x].combine_chunks()) for x in ("i", "j", "k", "node", "band", "c", "n", "out"))
                sig = _matrix(g["sig"].combine_chunks())
                doc, code = exact_sets(g["text"].combine_chunks())
                first = np.searchsorted(doc, np.arange(len(node) + 1))
                sets = [code[first[x] : first[x + 1]] for x in range(len(node))]
                forest = _Forest()
                for x in np.flatnonzero(out):
                    y = np.flatnonzero(((k != k[x]) | (i == j)) & (c != c[x]) & (~out | (node[x] < node)) & (100 * np.minimum(n, n[x]) >= percent * np.maximum(n, n[x])))
                    alive, m = _survivors(sig, sig, np.full(len(y), x), y, need)
                    own = _first_band(sig, np.full(len(alive), x), y[alive], band[y[alive]])
                    alive, m = alive[own], m[own]
                    for z in y[alive][np.lexsort((node[y[alive]], -m))]:
                        if forest.find(int(c[x])) != forest.find(int(c[z])):
                            same = len(np.intersect1d(sets[x], sets[z], assume_unique=True))
                            if 100 * same >= percent * (n[x] + n[z] - same):
                                forest.join(int(c[x]), int(c[z]))
                                a.append(node[x])
                                b.append(node[z])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.select(*_PAIRED, "node", "band", "c", "out", "n", "sig", "text").mapInArrow(links, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable) and kept."""
    return _decided(docs, percent).drop("key")


def _forests(edges: DataFrame) -> DataFrame:
    """Edges a, b of the same components: the forest of each task's links, as stars around its least nodes. Few links are one forest, which needs no round of contraction."""

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = _Forest()
        for batch in batches:
            for x, y in zip(batch["a"].to_pylist(), batch["b"].to_pylist()):
                f.join(x, y)
        stars = [(x, root) for x in list(f.up) if (root := f.find(x)) != x]
        for k in range(0, len(stars), LINKS):
            a, b = zip(*stars[k : k + LINKS])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return edges.select("a", "b").coalesce(edges.count() // LINKS + 1).mapInArrow(forest, "a long, b long")


def _components(docs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """node and component of the classes that have a link."""
    bands = _bands(classes)
    buckets = materialize(bands.groupBy("b").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("b", "least"), "buckets")
    members = materialize(bands.join(buckets.hint("merge"), "b"), "members")  # b, node, n, band, least
    nodes = materialize(members.select("node").distinct(), "nodes")
    texts = materialize(_texts(docs, nodes), "texts")
    # the members of each bucket with its least member
    pairs = members.where("node <> least").selectExpr("least as a", "node as b").distinct()
    edges = materialize(_verify(materialize(_prune(pairs, classes, percent), "likely"), texts, percent), "links")
    labels = materialize(components(_forests(edges)), "labels")
    # what that has not joined
    more = materialize(_across(_blocks(members, labels, "1", BLOCK), classes, percent), "across")
    pairs = more.where("bucket is null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    found = materialize(_verify(pairs, texts, percent), "links")
    if not found.isEmpty():
        edges = materialize(edges.unionByName(found), "links")
        labels = materialize(components(_forests(edges)), "labels")
    dense = more.where("bucket is not null").select(F.col("bucket").alias("b")).distinct()
    if not dense.isEmpty():
        found = materialize(_within(_blocks(members.join(dense.hint("merge"), "b", "left_semi"), labels, "n", TEXT_BLOCK), classes, texts, percent), "links")
        if not found.isEmpty():
            labels = materialize(components(_forests(edges.unionByName(found))), "labels")
    release(buckets, members, nodes, texts, more, edges)
    return labels


def _decided(docs: DataFrame, percent: int) -> DataFrame:
    """near_duplicates() and key, the hash of a row's id and text."""
    all_ = materialize(sketches(docs), "sketches")
    first = F.min(F.struct("doc_id", "key"))
    classes = materialize(all_.where("n > 0 and doc_id is not null").groupBy("n", "s1", "s2").agg(first.alias("x"), F.first("sig").alias("sig")).selectExpr("n", "s1", "s2", "x.doc_id as rep", "x.key as node", "sig"), "classes")
    labels = _components(docs, classes, percent)
    linked = classes.select("n", "s1", "s2", "rep", "node").join(labels.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = linked.groupBy("component").agg(F.min("rep").alias("component_id"))
    names = materialize(linked.join(least.hint("merge"), "component").select("n", "s1", "s2", "component_id"), "names")
    out = all_.where("doc_id is not null").select("doc_id", "key", "n", "s1", "s2").join(names.hint("merge"), ["n", "s1", "s2"], "left")
    out = out.select("doc_id", "key", "n", F.coalesce("component_id", "doc_id").alias("component_id")).unionByName(all_.where("doc_id is null").selectExpr("doc_id", "key", "n", "doc_id as component_id"))
    return out.select("doc_id", "key", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """docs, all columns, with one document of each component. Rows are told apart by id and text; of rows that repeat both one stays (that of the least hash over its columns).

    Only rows that may go are shuffled (common.near).
    """
    key = "hash of its id and text"
    got = materialize(_decided(docs, percent), "near")
    gone = got.where("not kept").select("doc_id", "key").distinct()
    twice = got.where("kept and doc_id is not null").groupBy("doc_id", "key").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "key")
    marked = materialize(gone.withColumn("goes", F.lit(True)).unionByName(twice.withColumn("goes", F.lit(False))), "gone")
    cols = [F.col(f"`{c}`") for c in docs.columns]
    ident = next(c for c in docs.columns if c.lower() == "doc_id")
    d, rest = near(docs.withColumn(key, _key()), F.col(f"`{key}`"), marked)
    m = marked.selectExpr("doc_id as `id of a copy`", "key as `key of a copy`", "goes as `goes as a copy`")
    d = d.join(m.hint("merge"), F.expr(f"`{key}` = `key of a copy` and try_cast(`{ident}` as long) = `id of a copy`"), "left")
    stay = d.where("`goes as a copy` is null").select(*cols).unionByName(rest.select(*cols))
    if twice.isEmpty():
        return stay
    hashed = [F.col(f"`{f.name}`") for f in docs.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    one = d.where("not `goes as a copy`").groupBy("id of a copy", "key of a copy").agg(F.min_by(F.struct(*cols), F.xxhash64(*hashed)).alias("row"))
    return stay.unionByName(one.select(*[F.col(f"row.`{c}`") for c in docs.columns]))


def op10_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL10 = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
g as (select distinct doc_id, hash(array_to_string(w[i:i + 4], ' ')) as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from g group by 1),
o as (select a.doc_id as a, b.doc_id as b, count(*) as inter from g a join g b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
e as (select a, b from o join n x on x.doc_id = a join n y on y.doc_id = b where 100 * inter >= 85 * (x.n + y.n - inter)),
s as (select a as u, b as v from e union all select b, a from e),
r(u, v) as (select u, v from s union select r.u, s.v from r join s on r.v = s.u),
c as (select u, least(u, min(v)) as c from r group by u)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(c.c, d.doc_id) as component_id, coalesce(c.c, d.doc_id) = d.doc_id as kept
from d left join n on n.doc_id = d.doc_id left join c on c.u = d.doc_id"""

QUERIES = {"op10_near_dedup": op10_near_dedup}
SQL = {"op10_near_dedup": SQL10}
