"""Quality rules with adaptive thresholds from mergeable quantile sketches per language and source.

Each statistic of a text is an integer ratio. Its sketch is a histogram whose bucket keeps the seven
leading bits of the value (relative error below 1/64); two sketches merge by adding counts, so the
result does not depend on partitioning or order, and the hot group is summed before any shuffle.
A group's upper fence is q75 + 3 * (q75 - q25) + a margin, its lower fence (word length only)
q25 - 3 * (q75 - q25) - a margin. A group with fewer than MIN_GROUP documents takes the fences of its language,
and that one, if as small, those of all documents: the sketches are merged, no text is read again.

Defined cases: a null text is as empty (all counts 0, base_failed). Null lang or source are groups
of their own. Repeated rows count as often as they stand. Ties: a value on a fence is kept. An empty table gives no rows. Extra
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytetext as bt
from .common import columns, materialize

MIN_GROUP = 100
#: name: (expression per document, margin); the first also has a lower fence
STATS = {
    "word_len": ("(100 * word_chars) div n_words", 100),
    "symbols": ("(1000 * n_symbols) div n_words", 100),
    "dup_lines": ("(1000 * n_dup_lines) div n_words", 30),
    "repeats": ("(1000 * n_repeat_words) div n_words", 150),
}
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_POINT = np.ones(256, bool)
_POINT[0x80:0xC0] = False


def base_counts(t: bt.Texts) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text of a slice."""
    w = t.words(bt.NOT_SPACE, lower=False)
    total = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[t.off])
    chars, symbols = total(bt.NOT_SPACE[t.data] & _POINT[t.data]), total(_SYMBOL[t.data])
    # lines: between newlines and the ends of texts
    cut = np.flatnonzero(t.data == 10)
    begin = np.concatenate((t.off[:-1], cut + 1))
    row = np.concatenate((np.arange(t.n), np.searchsorted(t.off[1:], cut, "right")))
    order = np.lexsort((begin, row))
    begin, row = begin[order], row[order]
    end = np.append(begin[1:] - 1, 0)
    last = np.append(row[1:] != row[:-1], True)
    end[last] = t.off[row[last] + 1]
    solid = np.concatenate(([0], np.cumsum(bt.NOT_SPACE[t.data])))
    has = solid[end] > solid[begin]
    begin, end, row = begin[has], end[has], row[has]
    _, first = bt.first_of_equal(row, bt.spans(t.data, begin, end))
    dup = np.bincount(row[~first], minlength=t.n)
    at, g = w.grams(3)
    n, _ = bt.first_of_equal(w.doc[at], g)
    hit = np.zeros(len(w.start), bool)
    for k in range(3):
        hit[at[n > 1] + k] = True
    return [w.count, chars, symbols, dup, np.bincount(w.doc[hit], minlength=t.n)]


def stats(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base counts, from one pass over whole texts; only numbers leave it."""
    d = columns(docs, doc_id="long", lang="string", source="string", text="string")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, t in bt.slices(b["text"]):
                found = [pa.array(x, pa.int64()) for x in base_counts(t)]
                yield pa.RecordBatch.from_arrays([b[c].slice(i, j - i) for c in ("doc_id", "lang", "source")] + found, ["doc_id", "lang", "source", *BASE])

    return d.mapInArrow(count, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in BASE)).withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))


def bucket(v: Column) -> Column:
    """The value without what lies below its seven leading bits."""
    step = F.pow(F.lit(2), F.greatest(F.length(F.bin(v)) - 7, F.lit(0))).cast("long")
    return v - v % step


def fences(st: DataFrame) -> DataFrame:
    """For each lang and source: lo_ and hi_ of every statistic."""
    rows = st.where("not base_failed").select("lang", "source", F.explode(F.array(*[F.struct(F.lit(k).alias("stat"), bucket(F.expr(e)).alias("b")) for k, (e, _) in STATS.items()])).alias("x")).select("lang", "source", "x.*")
    sketch = materialize(rows.groupBy("lang", "source", "stat", "b").agg(F.count("*").alias("n")), "sketch")

    def quartiles(s: DataFrame, keys: list[str], tag: str) -> DataFrame:
        keyed = ", ".join([*keys, "stat"])
        s = s.groupBy(*keys, "stat", "b").agg(F.sum("n").alias("n"))
        s = s.withColumn("upto", F.expr(f"sum(n) over (partition by {keyed} order by b)")).withColumn("all", F.expr(f"sum(n) over (partition by {keyed})"))
        out = s.groupBy(*keys, "stat").agg(F.max("all").alias("size"), F.min(F.expr("case when 4 * upto >= all then b end")).alias("q1"), F.min(F.expr("case when 4 * upto >= 3 * all then b end")).alias("q3"))
        return out.groupBy(*keys).agg(*[F.max(F.expr(f"case when stat = '{k}' then struct(size, q1, q3) end")).alias(f"{tag}_{k}") for k in STATS])

    groups = st.groupBy("lang", "source").agg(F.count("*").alias("rows")).drop("rows")
    a, b, c = quartiles(sketch, ["lang", "source"], "a"), quartiles(sketch, ["lang"], "b"), quartiles(sketch, [], "c").first()  # of all documents: one row
    b, a = b.withColumnRenamed("lang", "lang_"), a.withColumnsRenamed({"lang": "lang_", "source": "source_"})
    g = groups.join(a, F.expr("lang <=> lang_ and source <=> source_"), "left").drop("lang_", "source_").join(b, F.expr("lang <=> lang_"), "left").drop("lang_")
    out = []
    for k, (_, margin) in STATS.items():
        every = F.struct(*[F.lit(c[f"c_{k}"][x] if c and c[f"c_{k}"] else None).cast("long").alias(x) for x in ("size", "q1", "q3")])
        q = F.when(F.expr(f"a_{k}.size >= {MIN_GROUP}"), F.col(f"a_{k}")).when(F.expr(f"b_{k}.size >= {MIN_GROUP}"), F.col(f"b_{k}")).otherwise(every)
        out += [(q["q3"] + 3 * (q["q3"] - q["q1"]) + margin).alias(f"hi_{k}"), (q["q1"] - 3 * (q["q3"] - q["q1"]) - margin).alias(f"lo_{k}")]
    return g.select("lang", "source", *out)


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the base counts, base_failed, failed (names of the adaptive rules that a document breaks) and kept."""
    st = materialize(stats(docs), "stats")
    f = materialize(fences(st), "fences").withColumnsRenamed({"lang": "lang_", "source": "source_"})
    s = st.join(f, F.expr("lang <=> lang_ and source <=> source_"), "left")
    broken = [F.when(F.expr(f"{e} > hi_{k}" + (f" or {e} < lo_{k}" if k == "word_len" else "")), F.lit(k)) for k, (e, _) in STATS.items()]
    s = s.withColumn("failed", F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*broken))))
    return s.select("doc_id", "lang", "source", *BASE, "base_failed", "failed", (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"))


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", *BASE, "base_failed", "kept")


def _sql() -> str:
    bucket_sql = "v - v % (1::bigint << greatest(length(bin(v)) - 7, 0)::int)"
    stat = " union all ".join(f"select doc_id, lang, source, '{k}' as stat, {e.replace(' div ', ' // ')} as v, {m} as margin from st where not base_failed" for k, (e, m) in STATS.items())
    return f"""
with d as (select doc_id, lang, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
g as (select doc_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d)),
r as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as n from g) where n > 1),
rw as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i+1, i+2]) as p from r) group by 1),
l as (select doc_id, count(*) - count(distinct l) as n from (select doc_id, unnest(string_split(text, chr(10))) as l from d) where regexp_matches(l, '[^\\x20\\x09-\\x0D]') group by 1),
st0 as (select d.doc_id, lang, source, len(w)::bigint as n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g'))::bigint as word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols, coalesce(l.n, 0)::bigint as n_dup_lines, coalesce(rw.n, 0)::bigint as n_repeat_words
  from d left join l on l.doc_id = d.doc_id left join rw on rw.doc_id = d.doc_id),
st as (select *, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed from st0),
x as (select doc_id, lang, source, stat, v, margin, {bucket_sql} as b from ({stat})),
qa as (select lang, source, stat, count(*) as n, quantile_disc(b, 0.25) as q1, quantile_disc(b, 0.75) as q3 from x group by all),
qb as (select lang, stat, count(*) as n, quantile_disc(b, 0.25) as q1, quantile_disc(b, 0.75) as q3 from x group by all),
qc as (select stat, quantile_disc(b, 0.25) as q1, quantile_disc(b, 0.75) as q3 from x group by all),
f as (select x.doc_id, x.stat, v, margin, case when qa.n >= {MIN_GROUP} then qa.q1 when qb.n >= {MIN_GROUP} then qb.q1 else qc.q1 end as q1,
  case when qa.n >= {MIN_GROUP} then qa.q3 when qb.n >= {MIN_GROUP} then qb.q3 else qc.q3 end as q3
  from x join qa on qa.lang is not distinct from x.lang and qa.source is not distinct from x.source and qa.stat = x.stat
  join qb on qb.lang is not distinct from x.lang and qb.stat = x.stat join qc on qc.stat = x.stat),
bad as (select distinct doc_id from f where v > q3 + 3 * (q3 - q1) + margin or (stat = 'word_len' and v < q1 - 3 * (q3 - q1) - margin))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and doc_id not in (select doc_id from bad) as kept from st"""


QUERIES = {"op9_quality_rules": op9_quality_rules}
SQL = {"op9_quality_rules": _sql()}
