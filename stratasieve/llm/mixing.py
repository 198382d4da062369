"""Mixing sources to target weights by Pareto order sampling.

Each source's target is its share of all words (weights 5, 2, 1, repeating over the sources in code
point order, null last), stopped at three times its size; what a stopped source leaves is reshared by
weight (the fixed point is computed in one step: sources in the order of size/weight, the first that
the common level no longer fills bounds the stopped ones).

Inside a source documents are included with unequal probabilities: a document's value is BASE + the bits of its size (TOP at most), so that long documents
are repeated rather than short ones, and it is expected min(MOST, c * value) times, c such that the source's expected words are its target.
(Sizes have TOP values at most, so c follows from a row per source and value, as the targets do.) The whole part of that number is certain copies; for
the fraction lam, a document has the Pareto rank q = odds(u)/odds(lam), u a uniform number from a hash of its id, text and number among equal rows.
The documents of least rank are sampled until the source's words are nearest to its target: a sample of fixed size in words.

The cut is found without ordering a source in one task: words are summed by source and 4096 ranges
of q/(1+q), the range that holds the cut is split into 4096 again, and only the documents of that
small range are put in order. What leaves is a row per source and value; documents are then compared with
it, so no text is shuffled. The targets are computed over one row per source in one task.

Defined cases: a null text has size 0 and is taken 0 times; a source without words has target 0.
Null source is a source, last. Rows of one id with different texts are documents of their own; equal rows (source, id, text) are numbered, so that each is
drawn alone (which of them are taken is open if other columns differ). A null id is as the empty string. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytetext as bt
from .common import columns, materialize, near

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = "stratasieve-mix:"
RANGES = 4096
BASE, TOP = 8, 12
#: columns that stand beside those of documents while they are mixed
ID, NAME, SIZE, NUMBER = "mix id", "mix name", "mix size", "mix number"


@F.arrow_udf(T.LongType())
def n_words(text: pa.Array) -> pa.Array:
    found = [t.words(bt.NOT_SPACE, False, False).count for _, _, t in bt.slices(text)]
    return pa.chunked_array([pa.array(x, pa.int64()) for x in found], pa.int64()).combine_chunks()


def _named(docs: DataFrame) -> DataFrame:
    """docs with ID, NAME (hash of the text), SIZE (words) and NUMBER (0, 1, ... among rows of one source, id and text)."""
    name = {c.lower(): f"`{c}`" for c in docs.columns}
    text, ident = F.col(name["text"]).cast("string"), F.col(name["doc_id"]).try_cast("long")
    d = docs.withColumns({ID: ident, NAME: F.md5(F.coalesce(text, F.lit("")).cast("binary")), SIZE: n_words(F.coalesce(text, F.lit("")))})
    keys = [F.col(name["source"]).cast("string").alias("mix source"), F.col(ID), F.col(NAME)]
    again = d.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    key = F.xxhash64(*[k for k in keys])
    again = materialize(again.select(F.xxhash64("mix source", ID, NAME).alias("key")), "again")
    if again.isEmpty():
        return d.withColumn(NUMBER, F.lit(0).cast("long"))
    some, rest = near(d, key, again)
    # numbered in the parts of a written table, and parts in their order: no group is gathered
    cols = [F.col(f"`{c}`") for c in d.columns]
    some = materialize(some.select(*cols, F.spark_partition_id().alias("mix part"), F.monotonically_increasing_id().alias("mix row"), keys[0].alias("mix of")), "equal")
    by = f"`mix of`, `{ID}`, `{NAME}`"
    parts = some.groupBy("mix of", ID, NAME, "mix part").agg(F.count("*").alias("n")).withColumn("mix before", F.expr(f"coalesce(sum(n) over (partition by {by} order by `mix part` rows between unbounded preceding and 1 preceding), 0L)"))
    parts = parts.selectExpr("`mix of` as `mix of 2`", f"`{ID}` as `mix id 2`", f"`{NAME}` as `mix name 2`", "`mix part` as `mix part 2`", "`mix before`")
    some = some.withColumn("mix in part", F.expr(f"row_number() over (partition by {by}, `mix part` order by `mix row`) - 1"))
    some = some.join(parts, F.expr(f"`mix of` <=> `mix of 2` and `{ID}` <=> `mix id 2` and `{NAME}` = `mix name 2` and `mix part` = `mix part 2`"))
    return some.select(*cols, F.expr("`mix before` + `mix in part`").alias(NUMBER)).unionByName(rest.select(*cols, F.lit(0).cast("long").alias(NUMBER)))


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (the number of words), and name and number, which tell rows of one id apart."""
    return _named(columns(docs, doc_id="long", source="string", text="string")).select("doc_id", "source", F.col(SIZE).alias("size"), F.col(NAME).alias("name"), F.col(NUMBER).alias("number"))


def value(size: Column) -> Column:
    return F.least(F.length(F.bin(size)), F.lit(TOP)) + BASE


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target, whole (certain copies) and lam, one row per source."""
    per = materialize(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    s = per.selectExpr("source", "source_size", "cast(source_size as decimal(38,0)) as s", "row_number() over (order by source asc nulls last) as i")
    s = s.withColumn("w", F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.col("i") - 1) % len(weights) + 1).cast("int")).cast("decimal(10,0)"))
    order = "order by cast(s as double) / cast(w as double), i"
    s = s.selectExpr("*", "sum(s) over () as total", f"coalesce(sum(s) over ({order} rows between unbounded preceding and 1 preceding), 0) as below", f"sum(w) over ({order} rows between current row and unbounded following) as rest", f"row_number() over ({order}) as k")
    s = s.withColumn("free", F.expr(f"cast({most} * s * rest as decimal(38,0)) >= cast(w * (total - {most} * below) as decimal(38,0))"))
    s = s.withColumn("k0", F.expr("min(case when free then k end) over ()"))
    s = s.selectExpr("*", "max(case when k = k0 then cast(total - %d * below as double) end) over () as pool" % most, "max(case when k = k0 then cast(rest as double) end) over () as share")
    s = s.withColumn("target", F.expr(f"case when source_size = 0 then 0d when k < k0 then cast({most} * source_size as double) else cast(w as double) * pool / share end"))
    return s.select("source", "source_size", "target")


def inclusions(sized: DataFrame, goal: DataFrame, most: int = MOST) -> DataFrame:
    """source, source_size, target, v, whole (certain copies), lam, and left_over (the words that the source's sample shall have), a row per source and value."""
    w = sized.where("size > 0").groupBy("source", value(F.col("size")).alias("v")).agg(F.sum("size").alias("w"))
    g = goal.withColumnRenamed("source", "source_")
    k = w.join(g, F.expr("source <=> source_")).drop("source_")
    over = "over (partition by source order by v desc rows between {})"
    k = k.selectExpr("*", f"cast({most} * coalesce(sum(w) {over.format('unbounded preceding and 1 preceding')}, 0) as double) as capped", f"cast(sum(w * v) {over.format('current row and unbounded following')} as double) as rest", "row_number() over (partition by source order by v desc) as i")
    k = k.selectExpr("*", f"min(case when (target - capped) * cast(v as double) <= {most}D * rest then i end) over (partition by source) as i0")
    k = k.selectExpr("*", "max(case when i = i0 then target - capped end) over (partition by source) as pool", "max(case when i = i0 then rest end) over (partition by source) as share")
    k = k.selectExpr("*", f"case when i0 is null or i < i0 then {most}D else pool * cast(v as double) / share end as e")
    k = k.selectExpr("source", "source_size", "target", "v", "cast(floor(e) as long) as whole", "e - floor(e) as lam", "w")
    return k.selectExpr("source", "source_size", "target", "v", "whole", "lam", "target - cast(sum(whole * w) over (partition by source) as double) as left_over")


def rank(doc_id: Column, name: Column, number: Column, lam: Column) -> Column:
    """Pareto rank: odds of the document's uniform number over the odds of its inclusion; null where inclusion is 0."""
    key = F.concat(F.lit(SEED), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), name, F.lit(":"), number.cast("string"))
    u = (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(16**13)
    return F.when(lam > 0, (u / (1 - u)) / (lam / (1 - lam)))


_FIRST_ID = -(2**63)


def cuts(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """plan with at0 and last, the range and the place in the order of the last document that each source's sample holds (null: none)."""
    g = plan.select(F.col("source").alias("source_"), "v", "lam", "left_over")
    d = sized.where("size > 0").withColumn("v_", value(F.col("size"))).join(g, F.expr("source <=> source_ and v_ = v")).where("lam > 0")
    d = d.select("source", "doc_id", "name", "number", "size", "left_over", rank(F.col("doc_id"), F.col("name"), F.col("number"), F.col("lam")).alias("q"))
    d = d.withColumn("at", F.expr(f"least(q / (1 + q), 0.9999999999999999d) * {RANGES}D * {RANGES}D").cast("long"))
    upto = "sum(n) over (partition by source order by b)"

    def crossing(rows: DataFrame, name: str) -> DataFrame:
        """Of each source, the first range whose end reaches the goal, and the words before it."""
        s = rows.groupBy("source", "b").agg(F.sum("size").alias("n"), F.first("goal").alias("goal")).selectExpr("source", "b", "goal", "n", f"{upto} as upto")
        return materialize(s.where("upto >= goal").groupBy("source").agg(F.min(F.struct("b", (F.col("upto") - F.col("n")).alias("before"))).alias("x")).selectExpr("source as source_", "x.b as b0", "x.before"), name)

    one = crossing(d.selectExpr("source", f"at div {RANGES} as b", "size", "left_over as goal"), "range")
    d1 = d.join(one, F.expr(f"source <=> source_ and at div {RANGES} = b0")).drop("source_", "b0")
    two = crossing(d1.selectExpr("source", "at as b", "size", "left_over - before as goal"), "range").withColumnRenamed("before", "before2")
    d2 = d1.join(two, F.expr("source <=> source_ and at = b0")).drop("source_", "b0").withColumn("id", F.coalesce("doc_id", F.lit(_FIRST_ID)))
    ordered = d2.withColumn("ahead", F.expr("coalesce(sum(size) over (partition by source order by q, id, name, number rows between unbounded preceding and 1 preceding), 0) + before + before2"))
    # nearest to the goal: a document is in if the goal lies beyond its middle
    inside = ordered.where("2 * ahead + size < 2 * left_over").groupBy("source").agg(F.max(F.struct("q", "id", "name", "number")).alias("last")).selectExpr("source as source_", "last")
    floor = d2.groupBy("source").agg(F.min("at").alias("at0")).withColumnRenamed("source", "source__")
    last = floor.join(inside, F.expr("source__ <=> source_"), "left").selectExpr("source__ as source_", "at0", "last")
    return plan.join(last, F.expr("source <=> source_"), "left").drop("source_")


def _copies(named: DataFrame, goal: DataFrame, plan: DataFrame, kept: list[str]) -> DataFrame:
    """The columns kept, source_size, target and copies. goal has a row per source, plan one per source and value; Spark broadcasts them if they are small."""
    name = {c.lower(): f"`{c}`" for c in named.columns}
    source = f"cast({name['source']} as string)"
    g = goal.select(*[F.col(c).alias(f"mix {c}") for c in ("source", "source_size", "target")])
    p = plan.select(F.col("source").alias("mix planned"), *[F.col(c).alias(f"mix {c}") for c in ("v", "whole", "lam", "left_over", "at0", "last")])
    m = lambda c: F.col(f"`mix {c}`")
    d = named.join(g, F.expr(f"{source} <=> `mix source`"), "left").withColumn("mix value", value(m("size")))
    d = d.join(p, F.expr(f"{source} <=> `mix planned` and `mix value` = `mix v`"), "left").withColumn("mix q", rank(m("id"), m("name"), m("number"), m("lam")))
    at = F.expr(f"cast(least(`mix q` / (1 + `mix q`), 0.9999999999999999d) * {RANGES}D * {RANGES}D as long)")
    place = F.struct(m("q").alias("q"), F.coalesce(m("id"), F.lit(_FIRST_ID)).alias("id"), m("name").alias("name"), m("number").alias("number"))
    inside = F.when(m("at0").isNull(), m("left_over") > 0).otherwise((at < m("at0")) | ((at == m("at0")) & (place <= m("last"))))
    taken = m("whole") + F.coalesce(F.when(m("lam") > 0, inside), F.lit(False)).cast("long")
    return d.select(*[F.col(f"`{c}`") for c in kept], m("source_size").alias("source_size"), m("target").alias("target"), F.when(m("size") > 0, taken).otherwise(0).cast("long").alias("copies"))


def mix_plan(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """A row per source (source, source_size, target), and one per source and value (inclusions and cuts)."""
    goal = materialize(targets(sized, weights, most), "targets")
    plan = materialize(inclusions(sized, goal, most), "inclusions")
    return goal, materialize(cuts(sized, plan), "cuts")


def copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """docs with source_size, target and copies (columns of these names are replaced)."""
    goal, plan = mix_plan(materialize(sizes(docs), "sizes"), weights, most)
    return _copies(_named(docs), goal, plan, [c for c in docs.columns if c.lower() not in ("source_size", "target", "copies")])


def pareto_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target and copies of every document."""
    sized = materialize(sizes(docs), "sizes")
    named = sized.withColumns({ID: F.col("doc_id"), NAME: F.col("name"), SIZE: F.col("size"), NUMBER: F.col("number")})
    return _copies(named, *mix_plan(sized, weights, most), ["doc_id", "source", "size"])


def op4_pareto_mix(spark, sf_dir: str) -> DataFrame:
    out = pareto_mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


SQL4 = f"""
with d0 as (select doc_id, source, md5(coalesce(text, '')) as name, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size from documents),
d as (select *, row_number() over (partition by source, doc_id, name) - 1 as number from d0),
s as (select source, sum(size)::bigint as source_size from d group by 1),
i as (select *, row_number() over (order by source asc nulls last) as i from s),
w as (select *, [{', '.join(map(str, WEIGHTS))}][(i - 1) % {len(WEIGHTS)} + 1] as w from i),
o as (select *, sum(source_size) over () as total, coalesce(sum(source_size) over (order by source_size::double / w::double, i rows between unbounded preceding and 1 preceding), 0) as below,
  sum(w) over (order by source_size::double / w::double, i rows between current row and unbounded following) as rest, row_number() over (order by source_size::double / w::double, i) as k from w),
f as (select *, min(case when {MOST} * source_size * rest >= w * (total - {MOST} * below) then k end) over () as k0 from o),
p as (select *, max(case when k = k0 then (total - {MOST} * below)::double end) over () as pool, max(case when k = k0 then rest::double end) over () as share from f),
t as (select source, source_size, case when source_size = 0 then 0.0::double when k < k0 then ({MOST} * source_size)::double else w::double * pool / share end as target from p),
c as (select source, {BASE} + least(length(bin(size)), {TOP}) as v, sum(size)::bigint as w from d where size > 0 group by 1, 2),
c1 as (select c.*, source_size, target, ({MOST} * coalesce(sum(w) over (partition by c.source order by v desc rows between unbounded preceding and 1 preceding), 0))::double as capped,
  (sum(w * v) over (partition by c.source order by v desc rows between current row and unbounded following))::double as rest, row_number() over (partition by c.source order by v desc) as i from c join t on c.source is not distinct from t.source),
c2 as (select *, min(case when (target - capped) * v::double <= {MOST}::double * rest then i end) over (partition by source) as i0 from c1),
c3 as (select *, max(case when i = i0 then target - capped end) over (partition by source) as pool, max(case when i = i0 then rest end) over (partition by source) as share from c2),
c4 as (select *, case when i0 is null or i < i0 then {MOST}::double else pool * v::double / share end as e from c3),
c5 as (select *, floor(e)::bigint as whole, e - floor(e) as lam from c4),
c6 as (select *, target - (sum(whole * w) over (partition by source))::double as left_over from c5),
u as (select d.*, c6.whole, c6.lam, c6.left_over, (('0x' || substr(md5('{SEED}' || coalesce(doc_id::varchar, '') || ':' || name || ':' || number), 1, 13))::bigint::double + 0.5) / {float(16**13)!r}::double as u
  from d join c6 on d.size > 0 and d.source is not distinct from c6.source and c6.v = {BASE} + least(length(bin(size)), {TOP})),
q as (select *, case when lam > 0 then (u / (1 - u)) / (lam / (1 - lam)) end as q from u),
x as (select *, coalesce(sum(case when lam > 0 then size else 0 end) over (partition by source order by q, doc_id nulls first, name, number rows between unbounded preceding and 1 preceding), 0) as ahead from q)
select doc_id, size, source_size, target, 0::bigint as taken from d join t on d.source is not distinct from t.source where size = 0
union all select doc_id, size, source_size, target, (size * (whole + case when lam > 0 and 2 * ahead + size < 2 * left_over then 1 else 0 end))::bigint as taken from x join t on x.source is not distinct from t.source"""

QUERIES = {"op4_pareto_mix": op4_pareto_mix}
SQL = {"op4_pareto_mix": SQL4}
