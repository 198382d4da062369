"""Quality classifier: a sparse rule ensemble compiled to Spark columns.

Statistics of each whole text are counted in one pass (numbers only leave it). On the statistics of labelled
documents, shallow trees are grown on random subsets; every path from a root is a conjunctive rule
`stat <= t and stat > t ...`; an L1-penalised logistic regression over the rules keeps few of
them. The kept rules become one Spark column expression, 1 / (1 + exp(-(b + sum of weights of the rules that
hold))), which scores all documents in the JVM.

Fitted on at most MAX_TRAIN labelled ids, those of least hash; only their texts are measured before the fit, then all documents are
measured and scored in one pass. Labels come only from rows whose crc32(doc_id as text) mod 5 is not 0.

Defined cases: null and empty texts have all statistics 0 and are scored by the rules. Without labels of
both classes, every score is the smoothed share of class 1 ((n1 + 1) / (n + 2)). A label that is null is not read; of an id's labels the
commoner one is learned (ties: 0), and of the texts of one id the one with the least statistics. Repeated documents give a row each, an empty table none; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytetext as bt
from .common import columns, crc_mod, materialize
from .quality_rules import base_counts

MAX_TRAIN = 20_000
TREES, DEPTH, BINS = 24, 3, 32
PENALTY = 0.002
REJECT = 0.3
STATS = ["words", "word_len", "symbols", "bangs", "pipes", "upper", "digits", "stops", "commas", "repeats", "echoes", "distinct", "dup_lines", "lines", "long_words"]


def statistics(t: bt.Texts) -> np.ndarray:
    """[text, statistic]; ratios are per word, per letter or per line."""
    n_words, chars, symbols, dup, repeat = base_counts(t)
    w = t.words(bt.NOT_SPACE, True)
    has = lambda *codes: np.diff(np.concatenate(([0], np.cumsum(np.isin(t.data, codes))))[t.off])
    between = lambda a, b: np.diff(np.concatenate(([0], np.cumsum((t.data >= a) & (t.data <= b))))[t.off])
    upper, lower = between(65, 90), between(97, 122)
    echo = np.zeros(len(w.start), bool)
    if len(echo) > 1:
        echo[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    _, first = bt.first_of_equal(w.doc, w.hash)
    per = lambda x, y: x / np.maximum(y, 1)
    count = lambda mask: np.bincount(w.doc[mask], minlength=t.n)
    lines = has(10) + 1
    return np.stack([np.log2(1.0 + n_words), per(chars, n_words), per(symbols, n_words), per(has(33), n_words), per(has(124), n_words), per(upper, upper + lower), per(between(48, 57), chars), per(has(46, 63), n_words), per(has(44, 59), n_words), per(repeat, n_words), per(count(echo), n_words), per(count(first), n_words), per(dup, lines), per(lines, n_words), per(count(w.end - w.start > 20), n_words)], 1).astype(np.float64)


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, t in bt.slices(b["text"]):
                x = statistics(t)
                yield pa.RecordBatch.from_arrays([b["doc_id"].slice(i, j - i), *[pa.array(x[:, k]) for k in range(len(STATS))]], ["doc_id", *STATS])

    return columns(docs, doc_id="long", text="string").mapInArrow(count, "doc_id long, " + ", ".join(f"{s} double" for s in STATS))


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, True for <=, threshold), sorted


def _tree(x: np.ndarray, y: np.ndarray, cuts: list[np.ndarray], rng: np.random.Generator, path: Rule, rules: set[Rule]) -> None:
    """Grow by Gini gain over a random half of the statistics; each node below the root is a rule."""
    if path:
        rules.add(tuple(sorted(path)))
    if len(path) >= DEPTH or len(y) < 20 or y.min() == y.max():
        return
    best = None
    whole = len(y) * y.mean() * (1 - y.mean())
    for k in sorted(rng.permutation(x.shape[1])[: (x.shape[1] + 1) // 2]):
        if not len(cuts[k]):
            continue
        at = np.searchsorted(cuts[k], x[:, k], "left")  # <= cuts[i] iff at <= i
        n, s = np.bincount(at, minlength=len(cuts[k]) + 1), np.bincount(at, y, minlength=len(cuts[k]) + 1)
        nl, sl = np.cumsum(n)[:-1], np.cumsum(s)[:-1]
        nr, sr = len(y) - nl, y.sum() - sl
        ok = (nl >= 5) & (nr >= 5)
        if ok.any():
            gain = np.where(ok, whole - sl * (1 - sl / np.maximum(nl, 1)) - sr * (1 - sr / np.maximum(nr, 1)), -1)
            i = int(gain.argmax())
            if gain[i] > 1e-9 and (best is None or gain[i] > best[0]):
                best = (gain[i], k, cuts[k][i])
    if best:
        _, k, cut = best
        low = x[:, k] <= cut
        for side, keep in ((True, low), (False, ~low)):
            _tree(x[keep], y[keep], cuts, rng, (*path, (int(k), side, float(cut))), rules)


def holds(rules: list[Rule], x: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), len(rules)))
    for j, rule in enumerate(rules):
        for k, low, cut in rule:
            out[:, j] *= (x[:, k] <= cut) if low else (x[:, k] > cut)
    return out


def lasso(r: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = 600) -> tuple[float, np.ndarray]:
    """Intercept and L1-penalised weights of a logistic regression, by accelerated proximal gradient."""
    n, m = r.shape
    step = 4.0 / (1e-9 + float(np.linalg.norm(r, 2) ** 2) / n + 1)
    b, w = float(np.log((y.sum() + 1) / (n - y.sum() + 1))), np.zeros(m)
    vb, vw, t = b, w.copy(), 1.0
    for _ in range(steps):
        g = 1 / (1 + np.exp(-np.clip(vb + r @ vw, -30, 30))) - y
        nb = vb - step * g.mean()
        nw = vw - step * (r.T @ g) / n
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vb, vw = nb + (t - 1) / t2 * (nb - b), nw + (t - 1) / t2 * (nw - w)
        b, w, t = nb, nw, t2
    return float(b), w


class Model:
    """Rules, their weights and the intercept."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.rules, self.weights, self.b = [], np.zeros(0), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        if not len(y) or y.min() == y.max():
            return
        rng = np.random.Generator(np.random.PCG64(7))
        cuts = []
        for k in range(x.shape[1]):
            v = np.unique(x[:, k])
            mids = (v[1:] + v[:-1]) / 2
            cuts.append(np.unique(mids[np.linspace(0, len(mids) - 1, min(BINS * 4, len(mids))).astype(int)]) if len(mids) else mids)
        rules: set[Rule] = set()
        for _ in range(TREES):
            part = rng.permutation(len(y))[: max(20, len(y) // 2)]
            _tree(x[part], y[part], cuts, rng, (), rules)
        ordered = sorted(rules)
        r = holds(ordered, x)
        _, first = np.unique(r, axis=1, return_index=True)  # rules that hold for the same rows are one
        first = [j for j in sorted(first) if 0 < r[:, j].mean() < 1]
        if not first:
            return
        self.b, w = lasso(r[:, first], y)
        kept = np.flatnonzero(np.abs(w) > 1e-6)
        self.rules, self.weights = [ordered[first[j]] for j in kept], w[kept]

    def column(self, of: str = "") -> Column:
        """The ensemble as a Spark column over the statistics (fields of the struct `of`, if given)."""
        name = f"`{of}`." if of else ""
        terms = []
        for rule, weight in zip(self.rules, self.weights):
            text = " and ".join(f"{name}{STATS[k]} {'<=' if low else '>'} {cut!r}D" for k, low, cut in rule)
            terms.append(f"case when {text} then {float(weight)!r}D else 0D end")
        return F.expr(f"1D / (1D + exp(-({' + '.join([f'{self.b!r}D', *terms])})))")

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.b)
        for j, weight in enumerate(self.weights):
            z = z + holds([self.rules[j]], x)[:, 0] * weight
        return 1 / (1 + np.exp(-z))


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> Model:
    """Learn quality from the labelled ids that are not held out."""
    lab = columns(labels, doc_id="long", quality="int").where("doc_id is not null and quality in (0, 1)").where(crc_mod(F.col("doc_id"), 5) != 0)
    lab = lab.groupBy("doc_id").agg(F.avg("quality").alias("share")).selectExpr("doc_id", "if(share > 0.5, 1D, 0D) as y")
    lab = materialize(lab.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most), "labels")  # the `most` least of each task, then of all
    chosen = columns(docs, doc_id="long", text="string").join(F.broadcast(lab.select("doc_id")), "doc_id", "left_semi")  # `most` ids
    one = measure(chosen).groupBy("doc_id").agg(F.min(F.struct(*STATS)).alias("x"))
    rows = one.join(F.broadcast(lab), "doc_id").select("doc_id", "x.*", "y").toPandas().sort_values("doc_id")  # bounded by `most`
    return Model(rows[STATS].to_numpy(np.float64), rows["y"].to_numpy(np.float64))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the statistics, score and predicted of every row."""
    model = fit(docs, labels)
    return measure(docs).withColumn("score", model.column()).withColumn("predicted", (F.col("score") >= REJECT).cast("int"))


@F.arrow_udf(T.StructType([T.StructField(s, T.DoubleType()) for s in STATS]))
def _statistics(text: pa.Array) -> pa.Array:
    found = [statistics(t) for _, _, t in bt.slices(text)]
    x = np.concatenate(found) if found else np.zeros((0, len(STATS)))
    return pa.StructArray.from_arrays([pa.array(x[:, k]) for k in range(len(STATS))], STATS)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs, all columns, without rejected documents. No text is shuffled."""
    model = fit(docs, labels)
    text = {c.lower(): c for c in docs.columns}["text"]
    own = "statistics of the text"
    return docs.withColumn(own, _statistics(F.col(f"`{text}`").cast("string"))).where(model.column(own) >= REJECT).drop(own)


def op3_quality(spark, sf_dir: str) -> DataFrame:
    out = classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


QUERIES = {"op3_quality": op3_quality}
SQL: dict = {}
