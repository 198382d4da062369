"""Vectorised word splitting and hashing on Arrow's text buffers.

Texts are taken in slices of about SLICE_BYTES, so that memory does not grow with a batch; a longer text is a slice alone,
and its bytes are classed CHUNK at a time, so that what stays is some 32 bytes per word. Words are runs of bytes of
one class: for the classes used here (ASCII white space, or ASCII non-alphanumerics, as separators) this equals
the run of code points.

Hashes are 64 bits, equal on every machine and run. A word is folded eight bytes at a time through a mixer that is no
polynomial (words of up to eight bytes and one length never collide), a span of more than LONG bytes is hashed by BLAKE2b; a run of words is folded
from runs of 1, 2, 4, ... words. Where two texts are said to be equal, words are compared themselves: `exact` gives words
and runs codes that are equal only if the words are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

SLICE_BYTES = 1 << 20
CHUNK = 1 << 22
LONG = 256

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~SPACE
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = True
ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's last step."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two neighbouring runs from theirs."""
    x = a * _U(0x9E3779B97F4A7C17)
    x += b
    return mix(x)


def spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of each byte span, length included."""
    size = end - start
    h = mix((size.astype(np.uint64) + _U(1)) * _U(0xD6E8FEB86659FD93) ^ _U(seed))
    if not len(start):
        return h
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    rows = np.flatnonzero(size <= LONG)
    for k in range(0, LONG, 8):
        rows = rows[size[rows] > k]
        if not len(rows):
            break
        h[rows] = mix((h[rows] ^ (eight[start[rows] + k] & _MASK[np.minimum(size[rows] - k, 8)])) * _U(0xA0761D6478BD642F))
    for i in np.flatnonzero(size > LONG):
        h[i] ^= _U(int.from_bytes(hashlib.blake2b(data[start[i] : end[i]], digest_size=8, key=seed.to_bytes(8, "little")).digest(), "little"))
    return h


class Texts:
    """One slice of texts as bytes; off[i]:off[i+1] is text i."""

    def __init__(self, data: np.ndarray, off: np.ndarray) -> None:
        self.data, self.off, self.n = data, off, len(off) - 1

    def words(self, word: np.ndarray, lower: bool, hashes: bool = True) -> "Words":
        b = LOWER[self.data] if lower else self.data
        begin, close, last = [], [], False
        for c in range(0, len(b), CHUNK):
            w = word[b[c : c + CHUNK]]
            edge = np.flatnonzero(w[1:] != w[:-1]) + (c + 1)
            if w[0] != last:
                edge = np.concatenate(([c], edge))
            begin.append(edge[int(last) :: 2])  # words begin and end in turns
            close.append(edge[1 - int(last) :: 2])
            last = bool(w[-1])
        if last:
            close.append(np.array([len(b)]))
        start = np.concatenate(begin) if begin else np.zeros(0, np.int64)
        end = np.concatenate(close) if close else np.zeros(0, np.int64)
        # a word that runs over the edge of two texts is two
        inner = self.off[1:-1]
        inner = inner[(inner > 0) & (inner < len(b))]
        cut = np.unique(inner[word[b[inner]] & word[b[inner - 1]]]) if len(inner) else inner
        if len(cut):
            start, end = np.sort(np.concatenate((start, cut)), kind="stable"), np.sort(np.concatenate((end, cut)), kind="stable")
        return Words(self, b, start, end, hashes)


class Words:
    """Words of a slice, in order. doc: the text of each; first[i]:first[i+1] are the words of text i."""

    def __init__(self, texts: Texts, data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: bool, seed: int = 0) -> None:
        self.texts, self.data, self.start, self.end, self.seed = texts, data, start, end, seed
        self.first = np.searchsorted(start, texts.off)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(texts.n), self.count)
        self.hash = spans(data, start, end, seed) if hashes else None
        self._runs = [self.hash]

    def other(self, seed: int) -> "Words":
        """The same words under hashes that don't depend on the first ones."""
        return Words(self.texts, self.data, self.start, self.end, True, seed)

    def _level(self, k: int) -> np.ndarray:
        """Hash of the 2^k words from each place on (0 where there are fewer)."""
        while len(self._runs) <= k:
            x, half = self._runs[-1], 1 << (len(self._runs) - 1)
            out = np.zeros_like(x)
            if len(x) > half:
                out[:-half] = join(x[:-half], x[half:])
            self._runs.append(out)
        return self._runs[k]

    def starts(self, k: int) -> np.ndarray:
        """Places that begin a run of k words of one text."""
        return np.flatnonzero(np.arange(len(self.start)) + k <= self.first[1:][self.doc]) if len(self.start) else np.zeros(0, np.int64)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places that begin a run of k words of one text, and the run's hash."""
        at = self.starts(k)
        return at, self.runs(at, at + k)

    def runs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash of words a[i]:b[i], their number included."""
        n = b - a
        out = np.zeros(len(a), np.uint64)
        if not len(a):
            return out
        if (n == n[0]).all():  # of one length: no masks
            at, k = a, int(n[0])
            got = None
            for bit in range(k.bit_length() - 1, -1, -1):
                if k >> bit & 1:
                    x = self._level(bit)[at]
                    got = x if got is None else join(got, x)
                    at = at + (1 << bit)
            return mix(got ^ _U(k)) if got is not None else mix(out)
        at = a.copy()
        for bit in range(int(n.max()).bit_length() - 1, -1, -1):
            rows = np.flatnonzero(n >> bit & 1)
            if not len(rows):
                continue
            x = self._level(bit)[at[rows]]
            new = at[rows] == a[rows]
            out[rows] = np.where(new, x, join(out[rows], x))
            at[rows] += 1 << bit
        return mix(out ^ n.astype(np.uint64))

    def bytes_of(self, at: np.ndarray) -> pa.Array:
        """The words themselves, as binary."""
        size = self.end[at] - self.start[at]
        off = np.concatenate(([0], np.cumsum(size)))
        take = np.repeat(self.start[at] - off[:-1], size) + np.arange(off[-1])
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(off.astype(np.int64).tobytes()), pa.py_buffer(self.data[take].tobytes())])

    def exact(self) -> np.ndarray:
        """A code of each word of the slice: equal only for equal words."""
        if not len(self.start):
            return np.zeros(0, np.int64)
        return np.asarray(self.bytes_of(np.arange(len(self.start))).dictionary_encode().indices).astype(np.int64)

    def exact_runs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Text and code of each run of k words (a text of fewer, but not none: all its words); codes are equal only for equal runs."""
        code = self.exact()
        short = np.flatnonzero((self.count > 0) & (self.count < k))
        at = np.concatenate((self.starts(k), self.first[short]))
        size = np.concatenate((np.full(len(at) - len(short), k), self.count[short]))
        out = np.zeros(len(at), np.int64)
        for j in range(k):
            word = np.full(len(at), -1)
            has = size > j
            word[has] = code[at[has] + j]
            out = pd.factorize(out * (len(code) + 1) + word + 1)[0]
        return self.doc[at] if len(at) else np.zeros(0, np.int64), out


def slices(text: pa.Array | pa.ChunkedArray, most: int | None = None) -> Iterator[tuple[int, int, Texts]]:
    """Row ranges of about `most` bytes with their texts; null is as empty."""
    most = most or SLICE_BYTES
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    text = text.cast(pa.large_string()).fill_null("") if text.null_count or not pa.types.is_large_string(text.type) else text
    _, o, d = text.buffers()
    off = np.frombuffer(o, np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(d, np.uint8) if d is not None and d.size else np.zeros(0, np.uint8)
    a = 0
    while a < len(text):
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1)
        b = min(b, len(text))
        yield a, b, Texts(data[off[a] : off[b]], off[a : b + 1] - off[a])
        a = b


def one(texts: list[str]) -> Texts:
    """Texts from Python strings."""
    return next(iter(slices(pa.array(texts, pa.large_string()), 1 << 62)))[2] if texts else Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))


def first_of_equal(group: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row: the number of rows with its (group, key), and whether it is the first of them. group is ascending."""
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    order = np.lexsort((key, group))
    g, k = group[order], key[order]
    new = np.concatenate(([True], (g[1:] != g[:-1]) | (k[1:] != k[:-1])))
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(k)))
    n, first = np.empty(len(k), np.int64), np.zeros(len(k), bool)
    n[order] = np.repeat(size, size)
    first[order[at]] = True  # lexsort is stable
    return n, first
