"""Language ID by segmentation-marginalised unigrams.

The vocabulary is a public tokenizer's (its path is a parameter): all its lower-cased pieces of letters, of any
length, with the word-begin mark. For each language the pieces' probabilities are fitted by expectation maximisation over all
segmentations of the training words; a word's likelihood is the sum over all its segmentations
(forward algorithm), a text's the product over its words, a word being a maximal run of letters (Unicode category L).
The score is the posterior probability of the language given.

Training: documents whose crc32(doc_id as text) mod 3 is not 1 and whose text and lang are not null; at most
MAX_DOCS of each language, those of least hash of id and text (a bounded, documented sample; every document is
predicted, over its whole text). Rows that repeat language, id and text count once. The word counts of that sample are summed on the executors.

Defined cases: a null text, or one without letters, gives `und` and score 0; so does every text if there is
nothing to learn from. Characters outside the vocabulary cost the same in every language. Ties go to the
language first in code point order. Repeated rows give a row each, an empty table none; extra columns are
not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytetext as bt
from .common import columns, crc_mod

MAX_DOCS = 400
#: letters of the default vocabulary's longest piece, mark included; no limit: Lookup takes the length from its own pieces
MAX_PIECE = 16
ROUNDS = 3
#: words longer than this are scored one by one, in scaled steps
LONG = 48
UNKNOWN = 1e-7
#: chars * SCALE keeps likelihoods of words up to LONG letters within doubles
SCALE = 12.0
MARK = "▁"
CACHE = 300_000
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    """Maximal runs of letters, in lower case. The pattern's class also has number characters such as a half or a Roman ten; they part words."""
    found = _WORD.findall(text.lower())
    if text.isascii() or all(map(str.isalpha, found)):
        return found
    return [w for x in found for w in "".join(c if c.isalpha() else " " for c in x).split()]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def pieces(path: str) -> list[str]:
    """Distinct lower-cased pieces of letters, with or without the mark, of a sentencepiece model."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    out = {sp.id_to_piece(i).lower() for i in range(sp.get_piece_size())}
    return sorted(p for p in out if p == MARK or p.removeprefix(MARK).isalpha())


class Chars:
    """Words as code points, each with the mark in front; hashes of their substrings."""

    def __init__(self, words: list[str]) -> None:
        self.size = np.array([len(w) + 1 for w in words], np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.size)))
        self.text = np.frombuffer((MARK + MARK.join(words) if words else "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        self.n = len(self.text)

    def substrings(self, end: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For 1, 2, ... characters: the places whose substring lies before `end`, and its hash, folded a character at a time."""
        at = np.arange(self.n)
        h = np.zeros(self.n, np.uint64)
        for k in range(1, longest + 1):
            ok = at + k <= end[at]
            at, h = at[ok], h[ok]
            h = bt.join(h, self.text[at + k - 1] + np.uint64(1))
            yield at, h


class Lookup:
    """Ids of pieces by substring hash."""

    def __init__(self, vocabulary: list[str]) -> None:
        self.longest = max(map(len, vocabulary), default=1)
        c = Chars([p.removeprefix(MARK) for p in vocabulary])
        begin = c.start[:-1] + np.array([not p.startswith(MARK) for p in vocabulary], bool)
        h = np.zeros(len(vocabulary), np.uint64)
        for k, (at, got) in enumerate(c.substrings(np.repeat(c.start[1:], c.size), self.longest), 1):
            rows = np.flatnonzero(c.start[1:] - begin == k)
            h[rows] = got[np.searchsorted(at, begin[rows])]
        self.id = np.argsort(h)
        self.hash = h[self.id]

    def ids(self, c: Chars) -> np.ndarray:
        """[position, length - 1] -> id of the piece there, -1 for none or beyond the word's end."""
        out = np.full((c.n, self.longest), -1, np.int32)
        end = np.repeat(c.start[1:], c.size)
        for k, (at, h) in enumerate(c.substrings(end, self.longest), 1):
            i = np.searchsorted(self.hash, h)
            i[i == len(self.hash)] = 0
            ok = self.hash[i] == h
            out[at[ok], k - 1] = self.id[i[ok]]
        return out


class Lattice:
    """All segmentations of a list of words."""

    def __init__(self, lookup: Lookup, words: list[str]) -> None:
        self.c = Chars(words)
        self.ids = lookup.ids(self.c)
        self.order = np.argsort(-self.c.size, kind="stable")
        self.sizes = self.c.size[self.order]

    def _active(self, j: int) -> np.ndarray:
        return self.order[: int(np.searchsorted(-self.sizes, -j, "right"))]

    def _prob(self, at: np.ndarray, k: int, p: np.ndarray) -> np.ndarray:
        """Scaled probability of the piece of k letters at these positions; unknown single characters have UNKNOWN."""
        i = self.ids[at, k - 1]
        x = p[i]
        x[i < 0] = UNKNOWN if k == 1 else 0.0
        return x * SCALE**k

    def forward(self, p: np.ndarray) -> np.ndarray:
        """alpha[start + word number + j] is the scaled likelihood of a word's first j characters. p: [piece, language]."""
        c = self.c
        a = np.zeros((c.n + len(c.size), p.shape[1]))
        base = c.start[:-1] + np.arange(len(c.size))
        a[base] = 1
        for j in range(1, int(c.size.max(initial=0)) + 1):
            w = self._active(j)
            for k in range(1, min(self.ids.shape[1], j) + 1):
                at = c.start[w] + j - k
                some = self.ids[at, k - 1] >= 0 if k > 1 else slice(None)
                v, at = w[some], at[some]
                if len(v):
                    a[base[v] + j] += a[base[v] + j - k] * self._prob(at, k, p)
        return a

    def log_likelihood(self, p: np.ndarray) -> np.ndarray:
        """[word, language], summed over all segmentations. Long words are taken in steps that are scaled anew."""
        c = self.c
        if not len(c.size):
            return np.zeros((0, p.shape[1]))
        a = self.forward(p)
        last = c.start[:-1] + np.arange(len(c.size)) + c.size
        return np.log(a[last]) - (c.size * np.log(SCALE))[:, None]

    def expected(self, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected counts [piece, language] of the pieces over all segmentations; weight: [word, language]."""
        c, a = self.c, self.forward(p)
        base = c.start[:-1] + np.arange(len(c.size))
        z = a[base + c.size]
        b = np.zeros_like(a)
        b[base + c.size] = 1
        out = np.zeros_like(p)
        share = weight / np.maximum(z, 1e-300)
        for left in range(1, int(c.size.max(initial=0)) + 1):  # characters from here to the word's end
            w = self._active(left)
            for k in range(1, min(self.ids.shape[1], left) + 1):
                at = c.start[w] + c.size[w] - left
                some = self.ids[at, k - 1] >= 0 if k > 1 else slice(None)
                v, at = w[some], at[some]
                if not len(v):
                    continue
                here = base[v] + c.size[v] - left
                q = self._prob(at, k, p) * b[here + k]
                b[here] += q
                i = self.ids[at, k - 1]
                known = i >= 0
                for lang in range(p.shape[1]):
                    out[:, lang] += np.bincount(i[known], (a[here, lang] * q[:, lang] * share[v, lang])[known], minlength=len(p))
        return out


def long_word(lookup: Lookup, word: str, p: np.ndarray) -> np.ndarray:
    """Log likelihood of one word of any length, [language]: the same sum, scaled at each step."""
    c = Chars([word])
    ids = lookup.ids(c)
    ring = [np.ones(p.shape[1])]
    total = np.zeros(p.shape[1])
    for j in range(1, c.n + 1):
        x = np.zeros(p.shape[1])
        for k in range(1, min(lookup.longest, j) + 1):
            i = ids[j - k, k - 1]
            if i >= 0:
                x += ring[-k] * p[i]
            elif k == 1:
                x += ring[-1] * UNKNOWN
        ring = [r / x for r in ring[-lookup.longest :]] + [np.ones_like(x)]
        total += np.log(x)
    return total


class Model:
    """Piece probabilities of each language."""

    def __init__(self, vocabulary: list[str], langs: list[str], counts: list[tuple[str, str, int]], docs: dict[str, int]) -> None:
        self.langs, self.lookup = langs, Lookup(vocabulary)
        words = sorted({w for _, w, _ in counts if len(w) <= LONG})
        number, column = {w: i for i, w in enumerate(words)}, {x: i for i, x in enumerate(langs)}
        weight = np.zeros((len(words), len(langs)))
        for x, w, n in counts:
            if w in number:
                weight[number[w], column[x]] += n
        self.p = np.full((len(vocabulary), len(langs)), 1 / len(vocabulary))
        parts = [(Lattice(self.lookup, words[i : i + 20_000]), weight[i : i + 20_000]) for i in range(0, len(words), 20_000)]
        for _ in range(ROUNDS):
            e = sum((x.expected(self.p, w) for x, w in parts), np.zeros_like(self.p)) + 0.01
            self.p = e / e.sum(0)
        n = np.array([docs.get(x, 0) + 1.0 for x in langs])
        self.prior = np.log(n / n.sum())

    def words(self, found: list[str]) -> np.ndarray:
        out = np.zeros((len(found), len(self.langs)))
        size = np.array([len(w) for w in found], np.int64)
        few = np.flatnonzero(size <= LONG)
        for i in range(0, len(few), 20_000):
            part = few[i : i + 20_000]
            out[part] = Lattice(self.lookup, [found[k] for k in part]).log_likelihood(self.p)
        for k in np.flatnonzero(size > LONG):
            out[k] = long_word(self.lookup, found[k], self.p)
        return out


class Scorer:
    """Scores texts, keeping what it knows of words it has met."""

    def __init__(self, model: Model) -> None:
        self.m, self.at = model, {}
        self.table = np.zeros((0, len(model.langs)))

    def _rows(self, unique: np.ndarray) -> np.ndarray:
        if len(self.at) > CACHE:
            self.at, self.table = {}, self.table[:0]
        new = [w for w in unique if w not in self.at]
        if new:
            base = len(self.at)
            self.at.update(zip(new, range(base, base + len(new))))
            need = base + len(new)
            if need > len(self.table):
                self.table = np.concatenate((self.table[:base], np.zeros((max(need, 2 * base) - base, len(self.m.langs)))))
            self.table[base:need] = self.m.words(new)
        return self.table[np.fromiter(map(self.at.__getitem__, unique), np.int64, len(unique))]

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        found = [words(x) if x else [] for x in texts]
        n = np.array([len(x) for x in found])
        lang, score = ["und"] * len(texts), np.zeros(len(texts))
        if not n.sum() or not self.m.langs:
            return lang, score
        code, unique = pd.factorize(np.array([w for x in found for w in x], object))
        table, doc = self._rows(unique), np.repeat(np.arange(len(n)), n)
        ll = np.stack([np.bincount(doc, table[code, k], minlength=len(n)) for k in range(len(self.m.langs))], 1) + self.m.prior
        best = ll.argmax(1)
        top = ll[np.arange(len(n)), best]
        prob = 1 / np.exp(ll - top[:, None]).sum(1)
        for i in np.flatnonzero(n):
            lang[i], score[i] = self.m.langs[best[i]], prob[i]
        return lang, score


def fit(docs: DataFrame, vocabulary: str | None = None, most: int = MAX_DOCS) -> Model:
    """Learn from rows of docs with text and lang."""
    d = columns(docs, doc_id="long", text="string", lang="string").where("text is not null and lang is not null")
    d = d.withColumn("h", F.xxhash64("doc_id", "text"))
    sizes = d.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("h", 0.02).alias("different")).collect()  # a row per language
    n = {r["lang"]: r["n"] for r in sizes}
    langs = sorted(n)
    if not langs:
        return Model(pieces(vocabulary or default_vocabulary()), [], [], {})
    # hashes below a share of some more than `most` rows; of those, exactly the `most` least
    share = F.element_at(F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(1.0, (1.3 * most + 50) / max(r["different"], 1))))]), F.col("lang"))
    sample = d.where(F.expr("pmod(h, 1000003) / 1000003") < share).groupBy("lang", "h").agg(F.min("text").alias("text"))
    sample = sample.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.expr("pmod(h, 1000003)"), "h"))).where(F.col("place") <= most)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, text in zip(b["lang"].to_pylist(), b["text"].to_pylist()):
                found = pd.Series(words(text), dtype=object).value_counts()
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(list(found.index), pa.string()), pa.array(found.values, pa.int64())], ["lang", "word", "n"])

    counts = sample.select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toPandas()  # of the bounded sample
    return Model(pieces(vocabulary or default_vocabulary()), langs, list(zip(counts["lang"], counts["word"], counts["n"])), n)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by vocabulary and languages

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            for i, j, _ in bt.slices(b["text"]):
                lang, score = scorer.score(b["text"].slice(i, j - i).to_pylist())
                yield pa.RecordBatch.from_arrays([b["doc_id"].slice(i, j - i), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return columns(docs, doc_id="long", text="string").mapInArrow(predict, "doc_id long, lang_pred string, score double")


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(crc_mod(F.col("doc_id"), 3) != 1))
    return identify(docs, model).select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


QUERIES = {"op1_language_id": op1_language_id}
SQL: dict = {}
