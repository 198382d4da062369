"""URL filters over redirect-equivalent addresses.

A rule (host, path) fits its host and all subdomains where the url's path starts with the rule's; the longest rule
wins (by the length of host and path; an allow before a block of the same length). Redirects and canonical
links are edges between addresses: rel=canonical links and meta refreshes of the pages' html, and a table
of redirects if given. Connected components of the edges, found by distributed star contraction over
64-bit hashes of the addresses, are classes of aliases. A url's own rule decides it, so an explicit allow is
never overruled; a url without a rule is blocked if any alias of its class, page or link target, is
blocked by a rule, else allowed.

Addresses are compared without scheme and fragment, host in lower case. Relative targets are resolved against the page's
url (host, directory of the path, query alone, dot segments; a base element is not read); a target of another kind
of scheme, such as mailto:, is no edge. The SQL knows quoted links, whole or from the root, only.

Defined cases: a null url, or one without `://`, has host and path empty, no rule, no aliases: allow. Null html has no
links. Repeated rows give a row each. Pages with the same address are aliases. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns, components, materialize

#: (verdict, host, path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
_AZ = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_CANONICAL = [r"""(?i)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*?\bhref\s*=\s*["']([^"'>]+)""", r"""(?i)<link\b[^>]*\bhref\s*=\s*["']([^"'>]+)["'][^>]*?\brel\s*=\s*["']?canonical\b"""]
_UNQUOTED = [r"""(?i)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*?\bhref\s*=\s*([^"'>\s]+)(?=[\s>])""", r"""(?i)<link\b[^>]*\bhref\s*=\s*([^"'>\s]+)\s[^>]*?\brel\s*=\s*["']?canonical\b"""]
_REFRESH = r"""(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*?\burl\s*=\s*["']?([^"'>\s]+)"""


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(after_scheme(url), r"^([^/?#]*)", 1), *_AZ)


def path(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def address(url: Column) -> Column:
    """Host, path and query; null without a scheme."""
    return F.when(F.instr(url, "://") > 0, F.concat(host(url), F.regexp_extract(after_scheme(url), r"^[^/?#]*([^#]*)", 1)))


def rule(h: Column, p: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rh, rp in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[0] == "allow", r[1], r[2])):
        fits = ((h == rh) | h.endswith("." + rh)) & p.startswith(rp)
        out = F.when(fits, F.struct(F.lit(rh + rp).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _without_dots(p: Column) -> Column:
    """A path that begins with a slash, its dot segments removed."""
    parts = F.split(p, "/")
    parts = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(parts, F.array(F.lit("")))).otherwise(parts)
    step = lambda acc, x: F.when(x == ".", acc).when(x != "..", F.concat(acc, F.array(x))).when(F.size(acc) > 1, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc)
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def resolve(url: Column, target: Column) -> Column:
    """The target of a link on the page at url; null for schemes without `//`."""
    p, rest = F.regexp_extract(target, r"^([^?#]*)", 1), F.regexp_extract(target, r"^[^?#]*(.*)$", 1)
    root, base = F.concat(F.lit("http://"), host(url)), path(url)
    folder = F.when(base == "", "/").otherwise(F.regexp_replace(base, "[^/]*$", ""))
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(target.startswith("#"), url)
        .when(p == "", F.concat(root, base, rest))
        .otherwise(F.concat(root, _without_dots(F.when(p.startswith("/"), p).otherwise(F.concat(folder, p))), rest))
    )


def link_edges(pages: DataFrame) -> DataFrame:
    """source and target urls of canonical links and refreshes."""
    p = columns(pages, url="string", html="string").where("instr(url, '://') > 0 and html is not null").where(F.col("html").rlike("(?i)canonical|refresh"))
    found = F.array(*[F.regexp_extract("html", x, 1) for x in (*_CANONICAL, *_UNQUOTED, _REFRESH)])
    p = p.select("url", F.explode(F.array_distinct(found)).alias("t")).select("url", F.trim("t").alias("t")).where("t <> ''")
    return p.select(F.col("url").alias("source"), resolve(F.col("url"), F.col("t")).alias("target")).where("target is not null")


def judge(pages: DataFrame, redirects: DataFrame | None = None, rules=RULES) -> DataFrame:
    """page_id, url, host, path, rule, verdict and component (null: no aliases) of every page."""
    edges = link_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(columns(redirects, source="string", target="string"))
    edges = materialize(edges.select("source", "target", address(F.col("source")).alias("x"), address(F.col("target")).alias("y")).where("x <> y").select("source", "target", F.xxhash64("x").alias("a"), F.xxhash64("y").alias("b")), "edges")
    p = columns(pages, page_id="long", url="string")
    u = F.col("url")
    p = p.select("page_id", "url", F.coalesce(host(u), F.lit("")).alias("host"), F.coalesce(path(u), F.lit("")).alias("path"), F.xxhash64(address(u)).alias("node"))
    p = p.withColumn("r", rule(F.col("host"), F.col("path"), rules))
    if edges.isEmpty():  # no aliases: nothing is shuffled
        return p.select("page_id", "url", "host", "path", "r.rule", F.coalesce("r.verdict", F.lit("allow")).alias("verdict"), F.lit(None).cast("long").alias("component"))
    label = materialize(components(edges, "urls"), "labels")
    ends = edges.selectExpr("a as node", "source as url").union(edges.selectExpr("b", "target")).distinct()
    bad = ends.where(F.coalesce(rule(host(F.col("url")), path(F.col("url")), rules)["verdict"] == "block", F.lit(False))).select("node").distinct()
    blocked = label.join(bad, "node", "left_semi").select("component").distinct().withColumn("blocked", F.lit(True))
    label = materialize(label.join(blocked, "component", "left"), "blocked")
    p = p.join(label, "node", "left")
    method = F.when(F.col("blocked"), F.lit("block")).otherwise("allow")
    return p.select("page_id", "url", "host", "path", "r.rule", F.coalesce("r.verdict", method).alias("verdict"), "component")


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("url", "component")


def _sql() -> str:
    az = f"'{_AZ[0]}', '{_AZ[1]}'"
    after = "case when instr({u}, '://') > 0 then substr({u}, instr({u}, '://') + 3) else '' end"
    h = lambda u: f"translate(regexp_extract({after.format(u=u)}, '^([^/?#]*)', 1), {az})"
    p = lambda u: f"regexp_extract({after.format(u=u)}, '^[^/?#]*([^?#]*)', 1)"
    adr = lambda u: f"case when instr({u}, '://') > 0 then {h(u)} || regexp_extract({after.format(u=u)}, '^[^/?#]*([^#]*)', 1) end"
    order = sorted(RULES, key=lambda r: (len(r[1]) + len(r[2]), r[0] == "allow", r[1], r[2]), reverse=True)
    case = lambda what: "case " + " ".join(f"when (host = '{rh}' or ends_with(host, '.{rh}')) and starts_with(path, '{rp}') then '{what(v, rh, rp)}'" for v, rh, rp in order) + " end"
    rx = [x.replace("'", "''") for x in (*_CANONICAL, _REFRESH)]
    return f"""
with recursive l as (select distinct url, unnest([{', '.join(f"regexp_extract(html, '{x}', 1)" for x in rx)}]) as t from pages where instr(url, '://') > 0 and regexp_matches(html, '(?i)canonical|refresh')),
e0 as (select url as s, case when instr(t, '://') > 0 then t when starts_with(t, '//') then 'http:' || t when starts_with(t, '/') then 'http://' || {h('url')} || t end as t from l where t <> ''),
e as (select s, t, {adr('s')} as a, {adr('t')} as b from e0 where t is not null),
g as (select a as u, b as v from e where a <> b union select b, a from e where a <> b),
r(u, v) as (select u, v from g union select r.u, g.v from r join g on g.u = r.v),
ends as (select s as url, a as node from e where a <> b union select t, b from e where a <> b),
eh as (select node, {h('url')} as host, {p('url')} as path from ends),
bad as (select node from (select node, {case(lambda v, a, b: v)} as v from eh) where v = 'block'),
hit as (select distinct r.u as node from r join bad on bad.node = r.v union select node from bad),
x as (select page_id, coalesce({h('url')}, '') as host, coalesce({p('url')}, '') as path, {adr('url')} as node from pages)
select page_id, host, path, {case(lambda v, a, b: a + b)} as rule, coalesce({case(lambda v, a, b: v)}, case when node in (select node from hit) then 'block' else 'allow' end) as verdict from x"""


QUERIES = {"op6_url_filter": op6_url_filter}
SQL = {"op6_url_filter": _sql()}
