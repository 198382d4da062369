"""Chat formatting by quotation linking, in DataFrame functions only.

A line's quote level is the number of `>` at its start (spaces between them don't count). Consecutive lines of a level
are a passage; lines of level 0 are the message's own words. Passages are normalised (lower case, each run of other
than letters and digits one space, ends trimmed) and hashed with their conversation, in 128 bits of SHA-256: each line whole, and, as line breaks may differ, each SHINGLE words
in a row (all words, if the passage has fewer). A quoted line belongs to the earliest
message of the conversation that says the line in its own words, if that message is earlier; one without an equal line belongs to the latest of those messages
that first say some words in a row in which the line lies. A passage of one or two words must be a whole line or passage there. Only one
message per hash is joined, by a pre-aggregated minimum, so a line that everybody says costs one row.

A message's parent is the original of its quotes of
the least level (ties: the latest turn). Following parents (pointer doubling, a join per round) gives each
message's thread and depth.

Result, one row per message, text without quotes. In the order conversation, thread, turn (`ordered`; the query returns its rows so), every message comes
after the one it answers. Without quotes the order is that of the turns.

Defined cases: a null text is as empty; a message of quotes only has an empty text. Blank lines belong to no passage and
link nothing; lines that normalise to nothing don't link. Null conv_id or turn: the message has no links
and is its own thread. Rows that repeat (conv_id, turn) are messages of their own, told apart by role and text: each is linked by its own quotes, and where
two say a quoted line the one of least hash is the original. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns, materialize, release

_LINES = r"""transform(split(coalesce(text, ''), '\n'), l -> struct(
  length(regexp_replace(regexp_extract(l, '^[ \\t]*((?:>[ \\t]*)*)', 1), '[ \\t]', '')) as level,
  regexp_replace(l, '^[ \\t]*(?:>[ \\t]*)+', '') as line))"""


def normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " "))


#: words in a row that link a passage, and the least that are looked for inside another
SHINGLE, LEAST = 5, 3
#: a passage is one string: level, number of its first line, then its normalised lines
_PASSAGES = r"""filter(split(array_join(transform(said, (x, i) -> if(i = 0 or x.said = '' or said[i - 1].said = '' or said[i - 1].level <> x.level, concat('\u0003', x.level, '\u0001', i, '\u0001'), '\u0002') || x.said), ''), '\u0003'), x -> x <> '' and substring_index(x, '\u0001', -1) <> '')"""


#: a message, and what links to it
_ID = ["conv_id", "turn", "msg"]


def _hashed(words: str) -> Column:
    return F.expr(f"unhex(substring(sha2(concat(cast(conv_id as string), '\u0001', {words}), 256), 1, 32))")


def passage_words(messages: DataFrame) -> DataFrame:
    """_ID, level, words (w and the number of its line) of each passage."""
    said = F.transform("lines", lambda x: F.struct(x["level"].alias("level"), normal(x["line"]).alias("said")))
    p = messages.select(*_ID, said.alias("said")).select(*_ID, F.explode(F.expr(_PASSAGES)).alias("p"))
    p = p.select(*_ID, F.split("p", "\u0001").alias("p")).selectExpr(*_ID, "cast(p[0] as int) as level", "cast(p[1] as int) as i0", "split(p[2], '\u0002') as body")
    return p.selectExpr(*_ID, "level", "flatten(transform(body, (l, j) -> transform(split(l, ' '), w -> struct(w, i0 + j as i)))) as words")


def shingles(passages: DataFrame, size: str) -> DataFrame:
    """_ID, level, h, and the first and last line of all `size` words in a row of each passage."""
    p = passages.selectExpr("*", f"{size} as n").where("n > 0 and n <= size(words)")
    p = p.selectExpr(*_ID, "level", "inline(transform(sequence(1, size(words) - n + 1), k -> struct(slice(words, k, n) as x)))")
    return p.select(*_ID, "level", _hashed("array_join(x.w, ' ')").alias("h"), F.expr("x[0].i as lo"), F.expr("element_at(x, -1).i as hi"))


def _says() -> Column:
    return F.min(F.struct("turn", "msg")).alias("original")


def linked_by_passage(messages: DataFrame, own_lines: DataFrame) -> DataFrame:
    """_ID, level, i and original of each quoted line of which an earlier message says words in a row."""
    p = passage_words(messages)
    quoted = materialize(shingles(p.where("level > 0"), f"least(size(words), {SHINGLE})"), "shingles")
    own = shingles(p.where("level = 0"), f"if(size(words) < {LEAST}, size(words), 0)").unionByName(shingles(p.where("level = 0").selectExpr(*_ID, "level", "words", f"explode(sequence({LEAST}, {SHINGLE})) as m"), "m"))
    said = own.select("h", "turn", "msg").unionByName(own_lines.select("h", "turn", "msg")).join(quoted.select("h").distinct(), "h", "left_semi")
    first = materialize(said.groupBy("h").agg(_says()), "first_words")
    hit = quoted.join(first, "h").where("original.turn < turn")
    return hit.select(*_ID, "level", F.explode(F.sequence("lo", "hi")).alias("i"), "original").groupBy(*_ID, "level", "i").agg(F.max("original").alias("original"))


def linked_lines(messages: DataFrame) -> DataFrame:
    """_ID, level, i and original (turn, msg) of each quoted line that an earlier message says, as a line or in a passage."""
    m = messages.where("conv_id is not null and turn is not null")
    lines = m.select(*_ID, F.posexplode("lines").alias("i", "x")).select(*_ID, "i", "x.level", normal(F.col("x.line")).alias("said")).where("said <> ''").withColumn("h", _hashed("said"))
    quoted = materialize(lines.where("level > 0").select(*_ID, "level", "i", "h"), "quoted")
    if quoted.isEmpty():
        return quoted.select(*_ID, "level", "i", F.struct("turn", "msg").alias("original"))
    wanted = quoted.select("h").distinct()
    first = materialize(lines.where("level = 0").join(wanted, "h", "left_semi").groupBy("h").agg(_says()), "first")
    whole = materialize(quoted.join(first, "h").where("original.turn < turn").select(*_ID, "level", "i", "original"), "lines")
    parts = linked_by_passage(m, lines.where("level = 0"))
    return whole.unionByName(parts.join(whole, [*_ID, "level", "i"], "left_anti"))


def parents(linked: DataFrame) -> DataFrame:
    """_ID, parent (turn, msg) and links (quoted lines that were found): one row per message that answers another."""
    best = F.max(F.struct((-F.col("level")).alias("level"), F.col("original")))
    return linked.distinct().groupBy(*_ID).agg(best["original"].alias("parent"), F.count("*").alias("links"))


def threads(parent: DataFrame) -> DataFrame:
    """_ID, parent, links, thread (the turn of the first message of its chain) and depth, by pointer doubling."""
    t = materialize(parent.selectExpr("*", "parent as up", "1L as depth"), "threads")
    while True:
        nxt = t.selectExpr("conv_id as c", "struct(turn, msg) as u", "up as up2", "depth as depth2")
        j = t.join(nxt, F.expr("conv_id = c and up = u"), "left")
        j = materialize(j.selectExpr(*_ID, "parent", "links", "coalesce(up2, up) as up", "depth + coalesce(depth2, 0L) as depth", "up2 is not null as moved"), "threads")
        if j.where("moved").isEmpty():
            return j.selectExpr(*_ID, "parent.turn as parent", "links", "up.turn as thread", "depth")
        release(t)
        t = j.drop("moved")
        t._scratch = j._scratch


def build_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (without quotes), n_quoted (lines), max_level, links, parent, thread and depth of every message."""
    m = columns(conversations, conv_id="long", turn="long", role="string", text="string").withColumn("lines", F.expr(_LINES)).withColumn("msg", F.xxhash64("role", "text"))
    own = F.expr("trim(BOTH '\n' FROM array_join(transform(filter(lines, x -> x.level = 0), x -> x.line), '\n'))")
    out = m.select(*_ID, "role", F.when(F.exists("lines", lambda x: x["level"] > 0), own).otherwise(F.coalesce("text", F.lit(""))).alias("text"), F.expr("cast(size(filter(lines, x -> x.level > 0)) as long)").alias("n_quoted"), F.expr("cast(array_max(transform(lines, x -> x.level)) as long)").alias("max_level"))
    tree = threads(parents(linked_lines(m)))
    out = out.join(tree.selectExpr("conv_id as c", "turn as u", "msg as m", "parent", "links", "thread", "depth"), F.expr("conv_id = c and turn = u and msg = m"), "left")
    return out.selectExpr("conv_id", "turn", "role", "text", "n_quoted", "max_level", "coalesce(links, 0L) as links", "parent", "coalesce(thread, turn) as thread", "coalesce(depth, 0L) as depth")


def ordered(built: DataFrame) -> DataFrame:
    """Messages in reply order, range-partitioned and sorted; any conversation may span tasks."""
    return built.orderBy("conv_id", "thread", "turn")


def op2_quote_links(spark, sf_dir: str) -> DataFrame:
    return ordered(build_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet")).withColumn("text_sha256", F.sha2("text", 256)).drop("text"))


SQL2 = r"""
with recursive m as (select row_number() over (order by conv_id, turn, role, text) as r, conv_id, turn, role, coalesce(text, '') as text, string_split(coalesce(text, ''), chr(10)) as l from conversations),
n as (select r, conv_id, turn, unnest(l) as raw, unnest(range(len(l))) as i from m),
x as (select *, length(regexp_replace(regexp_extract(raw, '^[ \t]*((?:>[ \t]*)*)', 1), '[ \t]', '', 'g')) as level, regexp_replace(raw, '^[ \t]*(?:>[ \t]*)+', '') as line from n),
s as (select *, trim(regexp_replace(lower(line), '[^\p{L}\p{N}]+', ' ', 'g')) as said from x),
f as (select conv_id, said, min(turn) as turn, arg_min(r, turn) as original from s where level = 0 and said <> '' group by 1, 2),
k as (select s.r, s.level, f.original, f.turn from s join f on f.conv_id = s.conv_id and f.said = s.said where s.level > 0 and f.turn < s.turn),
p as (select r, arg_max(original, turn - level * 1000000000000) as up, max(turn - level * 1000000000000) as best, count(*) as links from k group by 1),
t(r, up, depth) as (select r, up, 1::bigint from p union all select t.r, p.up, t.depth + 1 from t join p on p.r = t.up),
d as (select r, max(depth) as depth, arg_max(up, depth) as top from t group by 1),
o as (select r, sum(case when level > 0 then 1 else 0 end)::bigint as n_quoted, max(level)::bigint as max_level, coalesce(trim(string_agg(line, chr(10) order by i) filter (level = 0), chr(10)), '') as own from s group by 1)
select m.conv_id, m.turn, m.role, n_quoted, max_level, coalesce(p.links, 0)::bigint as links, u.turn as parent, coalesce(z.turn, m.turn) as thread, coalesce(d.depth, 0)::bigint as depth, sha256(case when max_level > 0 then own else m.text end) as text_sha256
from m join o on o.r = m.r left join p on p.r = m.r left join m u on u.r = p.up left join d on d.r = m.r left join m z on z.r = d.top"""

QUERIES = {"op2_quote_links": op2_quote_links}
SQL = {"op2_quote_links": SQL2}
