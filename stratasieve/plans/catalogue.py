"""Queries of the catalogue, one for each operator, and SQL that gives the same rows."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import policy, scalar
from ..functions import references as ref
from ..functions import secrets as s
from ..operators import detect as det
from ..operators import findings as fnd
from ..operators import metadata as meta
from ..operators import replay as rep
from ..operators import rules, state
from ..sources import layers, store
from . import inputs as i
from . import jobs
from . import read_api as api
from . import scan
from .inputs import DUCK

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, and its SQL if it has one."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def scratch(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a local session may have one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return found.rstrip("/") if found else "file://" + tempfile.mkdtemp(prefix="stratasieve-")


def _quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _any(value: str, words) -> str:
    return "(" + " or ".join(f"contains(lower({value}), {_quote(w)})" for w in words) + ")"


def _base(path: str) -> str:
    return f"regexp_extract(lower(trim({path})), '([^/]*)$', 1)"


def _traits(path: str, key: str, value: str) -> str:
    files = ", ".join(map(_quote, s.SENSITIVE_FILES))
    return f"(({_base(path)} in ({files}) or {_any(path, s.SENSITIVE_IN_PATH)})::int + {_any(key, s.SENSITIVE_IN_KEY)}::int + {_any(value, s.SENSITIVE_IN_VALUE)}::int)"


def _confidence(base: str, path: str, key: str, value: str) -> str:
    t = _traits(path, key, value)
    return f"case when {base} = 'low' and {t} >= 2 then 'high' when {base} = 'low' and {t} = 1 then 'medium' when {base} = 'medium' and {t} >= 1 then 'high' else {base} end"


def _re2(pattern: str) -> str:
    return _quote(pattern.replace(r"\Z", "$"))


MATCHES = ["content_id", "detector_name", "value", "match_start", "match_end", "confidence", "priority"]


def _matches(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.col("value").cast("string")).select(*MATCHES)


def _detector(rule: str) -> None:
    """detect_<rule> over the rows of that rule's tokens."""
    token = i.token_rows(rule)
    path = i.TOKENS[rule][3]
    same = [r for r in rules.RULES if r.name == rule and r.key is None]
    r = next((r for r in same if r.path and path and re.search(r.path, path)), same[-1])
    check = i.TOKENS[rule][5] or "true"
    sql = f"""
with c as ({token(DUCK)}), m as (select *, regexp_extract(content, {_re2(r.pattern)}, {r.group}) as v from c)
select content_id, '{rule}' as detector_name, v as value, strlen(substr(content, 1, instr(content, v) - 1))::bigint as match_start, (strlen(substr(content, 1, instr(content, v) - 1)) + strlen(v))::bigint as match_end,
  {_confidence(_quote(r.base), 'file_path', 'key', 'v')} as confidence, {r.priority}::int as priority from m where v <> '' and {check}"""
    query(f"detect_{rule}", sql)(lambda spark, d: _matches(det.detect(i.rows(spark, d, token), {rule})))


for _rule in i.TOKENS:
    _detector(_rule)


def _env_rows(d) -> str:
    arms = {0: ("GITHUB_TOKEN", f"'ghp_' || {i.HEX(d, 'g', 1, 36)}"), 1: ("STRIPE", f"'sk_live_' || {i.HEX(d, 't', 1, 24)}"), 2: ("AWS_ID", f"'AKIA' || upper({i.HEX(d, 'a', 1, 16)})"), 3: ("PATH", "'/usr/bin'")}
    key = " ".join(f"when {n} then '{k}'" for n, (k, _) in arms.items())
    value = " ".join(f"when {n} then {v}" for n, (_, v) in arms.items())
    k = "case cast(c_custkey % 4 as int) " + key + " end"
    path = "case cast(c_custkey % 5 as int) when 0 then 'app/tests/.env' when 1 then 'app/.env.example' else '' end"
    return f"select c_custkey as content_id, 'sha256:m' || (c_custkey % 3) as manifest_digest, 'env' as source_type, {path} as file_path, {k} as key, {k} || '=' || case cast(c_custkey % 4 as int) {value} end || case when c_custkey % 9 = 0 then ' # placeholder' else '' end as content from customer"


_TOKEN3 = "|".join(r.pattern for r in rules.RULES if r.name in ("github_token", "stripe_key", "aws_access_key_id"))


@query(
    "detect_env_tokens",
    f"""
with c as ({_env_rows(DUCK)}), m as (select *, regexp_extract(content, {_re2(_TOKEN3)}, 0) as v from c),
f as (select *, case when starts_with(v, 'ghp_') then 'github_token' when starts_with(v, 'sk_') then 'stripe_key' else 'aws_access_key_id' end as detector_name,
  case when contains(file_path, '/tests/') then 'test_path' when contains(file_path, '.example') then 'example_path' when contains(content, 'placeholder') then 'placeholder_marker' else '' end as reason from m where v <> '')
select detector_name, case when reason = '' then 'actionable' else 'example' end as disposition, reason as disposition_reason, 'high' as confidence, count(*) as findings, count(distinct sha256(v)) as fingerprints from f group by all""",
)
def detect_env_tokens(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: rows to matches to findings, deduplicated and counted."""
    m = det.detect(i.rows(spark, d, _env_rows), {"github_token", "stripe_key", "aws_access_key_id"})
    f = fnd.dedup_detailed(fnd.normalise(m).withColumn("source_location", F.concat("source_location", F.lit("#"), "fingerprint")))
    return f.groupBy("detector_name", "disposition", "disposition_reason", "confidence").agg(F.count("*").alias("findings"), fnd.unique_fingerprints(f).alias("fingerprints"))


# --- candidates, keys and structured files -----------------------------------------------------------------------------------

_LINE_SQL = f"""
with c as ({i.candidate_rows(DUCK)}), l as (select *, string_split(content, chr(10))[2] as line from c),
k as (select *, regexp_extract(line, {_re2(rules.CANDIDATE)}, 0) as v from l where regexp_matches(lower(line), {_re2(s.KEYWORDS.decode())})),
p as (select *, substr(line, 1, instr(line, v) - 1) as pre, strlen(content) - strlen(line) as off from k where v <> ''),
a as (select *, regexp_matches(pre, '(=|:|=>)["\\x60]*\\s*$') and regexp_matches(right(lower(pre), 96), {_re2(s.KEYWORDS.decode())}) as ok, list_entropy(string_split(v, '')) as h from p)"""


@query("documents_entropy_candidates", f"{_LINE_SQL} select content_id, v as value, (off + strlen(pre))::bigint as match_start, (off + strlen(pre) + strlen(v))::bigint as match_end, case when not ok then 'no_context' when h < 3.75 then 'low_entropy' else '' end as verdict from a")
def documents_entropy_candidates(spark: SparkSession, d: str) -> DataFrame:
    out = det.entropy_candidates(i.rows(spark, d, i.candidate_rows))
    return out.select("content_id", F.col("value").cast("string").alias("value"), "match_start", "match_end", "verdict")


@query("detect_entropy", f"{_LINE_SQL} select content_id, 'keyword_entropy' as detector_name, v as value, (off + strlen(pre))::bigint as match_start, (off + strlen(pre) + strlen(v))::bigint as match_end, {_confidence(_quote('low'), 'file_path', 'key', 'v')} as confidence, 1::int as priority from a where ok and h >= 3.75")
def detect_entropy(spark: SparkSession, d: str) -> DataFrame:
    return _matches(det.detect(i.rows(spark, d, i.candidate_rows), {"keyword_entropy"}))


@query("documents_keyword_lines", f"select doc_id, len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(lower(l), {_re2(s.KEYWORDS.decode())})))::bigint as keyword_lines, len(string_split(text, chr(10)))::bigint as lines from documents")
def documents_keyword_lines(spark: SparkSession, d: str) -> DataFrame:
    ls = F.split("text", "\n")
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.size(F.filter(ls, lambda x: F.lower(x).rlike(s.KEYWORDS.decode()))).cast("long").alias("keyword_lines"), F.size(ls).cast("long").alias("lines"))


def _key_rows(d) -> str:
    v = f"substr({d.h(i.K + " || 'kv'")}, 1, 20) || upper(substr({d.h(i.K + " || 'kw'")}, 1, 20))"
    return f"select c_custkey as content_id, case cast(c_custkey % 4 as int) when 0 then 'CLIENT_SECRET=' || {v} when 1 then {v} when 2 then 'see ' || {v} else 'x: \"' || {v} || '\"' end as content, '' as file_path, case when c_custkey % 3 = 0 then 'oauth.client_secret' when c_custkey % 3 = 1 then 'AWS_SECRET_ACCESS_KEY' else 'name' end as key from customer"


def _key_sql(rule: str, key: str, pattern: str, base: str, priority: int, check: str) -> str:
    return f"""
with c as ({_key_rows(DUCK)}), m as (select *, unnest(regexp_extract_all(content, {_re2(pattern)})) as v from c where regexp_matches(lower(key), {_re2(key)})),
p as (select *, substr(content, 1, instr(content, v) - 1) as pre, substr(content, instr(content, v) + length(v)) as post from m)
select content_id, '{rule}' as detector_name, v as value, strlen(pre)::bigint as match_start, (strlen(pre) + strlen(v))::bigint as match_end, {_confidence(_quote(base), 'file_path', 'key', 'v')} as confidence, {priority}::int as priority
from p where (regexp_matches(pre, '(=|:|=>)["\\x60]*\\s*$') or (trim(pre) = '' and trim(post) = '')) and {check}"""


_KEYED = {r.name: r for r in rules.RULES if r.key}


@query("detect_keyvalue_assigned", _key_sql("assigned_sensitive_value", _KEYED["assigned_sensitive_value"].key, _KEYED["assigned_sensitive_value"].pattern, "medium", 4, "list_entropy(string_split(v, '')) >= 3.75"))
def detect_keyvalue_assigned(spark: SparkSession, d: str) -> DataFrame:
    return _matches(det.detect(i.rows(spark, d, _key_rows), {"assigned_sensitive_value"}))


@query("detect_keyvalue_aws", _key_sql("aws_secret_access_key", _KEYED["aws_secret_access_key"].key, _KEYED["aws_secret_access_key"].pattern, "high", 3, "regexp_matches(v, '^[A-Za-z0-9/+=]{40}$') and regexp_matches(v, '[a-z]') and regexp_matches(v, '[A-Z]')"))
def detect_keyvalue_aws(spark: SparkSession, d: str) -> DataFrame:
    return _matches(det.detect(i.rows(spark, d, _key_rows), {"aws_secret_access_key"}))


def _aws_rows(d) -> str:
    secret = f"upper({i.HEX(d, 'x', 1, 20)}) || {i.HEX(d, 'x', 21, 20)}"
    return f"select c_custkey as content_id, '# top' || chr(10) || 'aws_access_key_id = AKIA' || upper({i.HEX(d, 'a', 1, 16)}) || chr(10) || '[profile Dev]' || chr(10) || 'aws_access_key_id: \"AKIA' || upper({i.HEX(d, 'b', 1, 16)}) || '\"' || chr(10) || case when c_custkey % 2 = 0 then 'aws_secret_access_key = ' || {secret} || chr(10) else '' end || 'region = eu' as content, 'home/.aws/credentials' as file_path, '' as key from customer"


@query(
    "detect_aws_profiles",
    f"""
with c as ({_aws_rows(DUCK)}), l as (select content_id, unnest(string_split(content, chr(10))) as line, unnest(range(1, len(string_split(content, chr(10))) + 1)) as i, content from c),
o as (select *, sum(strlen(line) + 1) over (partition by content_id order by i) - strlen(line) - 1 as off, last_value(case when line like '[%]' then lower(regexp_replace(line[2:-2], '^profile ', '')) end ignore nulls) over (partition by content_id order by i) as sec from l),
e as (select *, lower(trim(regexp_extract(line, '^([^=:]*)[=:]', 1))) as k, regexp_extract(line, '[=:][ \\t]*"?([^" \\t]*)"?', 1) as v from o where line like 'aws%'),
m as (select *, max((k = 'aws_secret_access_key')::int) over (partition by content_id, sec) as sure from e)
select content_id, 'aws_shared_credentials_' || substr(k, 5) as detector_name, v as value, (off + instr(line, v) - 1)::bigint as match_start, (off + instr(line, v) - 1 + strlen(v))::bigint as match_end, case when sure = 1 then 'high' else 'medium' end as confidence, 4::int as priority
from m where k = 'aws_access_key_id' or (regexp_matches(v, '[a-z]') and regexp_matches(v, '[A-Z]'))""",
)
def detect_aws_profiles(spark: SparkSession, d: str) -> DataFrame:
    return _matches(det.detect(i.rows(spark, d, _aws_rows), {"aws_shared_credentials"}))


def _git_rows(d) -> str:
    return f"select c_custkey as content_id, 'https://plain.io' || chr(10) || 'https://u' || c_custkey || ':' || {i.HEX(d, 'gc', 1, 12)} || '@git.io' || chr(10) as content, case when c_custkey % 4 = 0 then 'x/.git-credential' else 'root/.git-credentials' end as file_path, '' as key from customer"


@query("detect_git_credentials", f"with c as ({_git_rows(DUCK)}), m as (select *, regexp_extract(content, ':([0-9a-f]+)@', 1) as v from c where file_path like '%.git-credentials') select content_id, 'git_credentials_password' as detector_name, v as value, strlen(substr(content, 1, instr(content, ':' || v || '@')))::bigint as match_start, (strlen(substr(content, 1, instr(content, ':' || v || '@'))) + strlen(v))::bigint as match_end, 'high' as confidence, 4::int as priority from m")
def detect_git_credentials(spark: SparkSession, d: str) -> DataFrame:
    return _matches(det.detect(i.rows(spark, d, _git_rows), {"git_credentials_password"}))


def _library_rows(d) -> str:
    return f"select c_custkey as content_id, case cast(c_custkey % 3 as int) when 0 then 'db https://u' || c_custkey || ':' || {i.HEX(d, 'lib', 1, 10)} || '@h.io/p/' || c_custkey || ' end' when 1 then 'secret: dapi' || {i.HEX(d, 'lib', 1, 32)} || chr(10) || 'host: w' || c_custkey || '.cloud.databricks.com' else 'nothing' end as content, '' as file_path, '' as key from customer"


@query("detect_keyword_library", f"""
with c as ({_library_rows(DUCK)})
select content_id, 'uri' as detector_name, regexp_extract(content, 'https://[^ ]+', 0) as value, 3::bigint as match_start, (3 + strlen(regexp_extract(content, 'https://[^ /]+', 0)))::bigint as match_end, 'medium' as confidence, 2::int as priority from c where content_id % 3 = 0
union all select content_id, 'databricks_token', regexp_extract(content, 'dapi[0-9a-f]{{32}}', 0) || regexp_extract(content, 'w[0-9]+.cloud.databricks.com', 0), 8, 44, 'medium', 2 from c where content_id % 3 = 1""")
def detect_keyword_library(spark: SparkSession, d: str) -> DataFrame:
    return _matches(det.detect(i.rows(spark, d, _library_rows), {"keyword_library"}))


def _both_rows(d) -> str:
    return f"select c_custkey as content_id, '{{\"auth\": \"' || {d.b64(f"'user' || c_custkey || ':' || {i.HEX(d, 'd', 1, 8)}")} || '\"}}' as content, case when c_custkey % 2 = 0 then 'root/.docker/config.json' else 'etc/other.json' end as file_path, '' as key from customer"


@query("match_precedence", f"""
with c as ({_both_rows(DUCK)}), v as (select *, regexp_extract(content, '"auth": "([^"]+)"', 1) as v from c),
m as (select content_id, v, 3 as priority from v union all select content_id, v, 4 from v where file_path like '%.docker/config.json'),
r as (select *, row_number() over (partition by content_id, v order by priority desc) as k from m)
select content_id, 'docker_auth_blob' as detector_name, v as value, 10::bigint as match_start, (10 + strlen(v))::bigint as match_end, 'high' as confidence, priority::int as priority from r where k = 1""")
def match_precedence(spark: SparkSession, d: str) -> DataFrame:
    return _matches(det.detect(i.rows(spark, d, _both_rows), {"docker_auth_blob"}))


# --- policy ------------------------------------------------------------------------------------------------------------------


def _value_rows(d) -> str:
    b = lambda x: d.b64(f"'{x}' || c_custkey")
    return f"select c_custkey as id, case cast(c_custkey % 7 as int) when 0 then 'FooBar' || c_custkey when 1 then {b('foo:bar')} when 2 then 'http://user:x@example.com/' || c_custkey when 3 then '  ' when 4 then 'real' || c_custkey when 5 then {b('user:secret')} else 'ADMIN@example.com' end as value from customer"


@query("discard_placeholders", f"with c as ({_value_rows(DUCK)}) select id, value, case when trim(value) = '' then 'empty_value' when regexp_matches(lower(value), 'foobar|foo:bar|(user|admin|test)@example.com') or (id % 7 = 1) or regexp_matches(value, '^http://user:x@example.com') then 'discard_placeholder' else '' end as reason from c")
def discard_placeholders(spark: SparkSession, d: str) -> DataFrame:
    @F.arrow_udf("string")
    def reason(v: pa.Array) -> pa.Array:
        return pa.array([s.discard_reason((x or "").encode()) for x in v.to_pylist()], pa.string())

    return i.rows(spark, d, _value_rows).select("id", "value", reason("value").alias("reason"))


def _policy_rows(d) -> str:
    pick = lambda col, n, xs: f"case cast(c_custkey % {n} as int) " + " ".join(f"when {k} then '{x}'" for k, x in enumerate(xs)) + " else '' end"
    return f"select c_custkey as id, {pick('path', 11, ['a/Tests/x', 'conf/.env.example', 'docs/setup.env', 'home/.npmrc', 'app/x.sample.yml', 'b/mocks2/x', 'examples/q', 'root/id_rsa'])} as path, {pick('key', 7, ['API_TOKEN', 'demo_key', 'x', 'MY_SAMPLE', 'password'])} as key, {pick('line', 5, ['see localhost', 'put your_token_here', 'plain', 'https://example.org'])} as line, {pick('value', 9, ['AKIAEXAMPLE', 'changeme', 'ghp_abc', 'zzz', '127.0.0.1:1', 'sk_live_1'])} as value, {pick('base', 3, ['low', 'medium', 'high'])} as base from customer"


_SEG = lambda words: f"regexp_matches(lower(path), '(^|/)({'|'.join(words)})(/|$)')"
_HOST = f"({_any('line', policy.RESERVED_HOSTS)} or {_any('value', policy.RESERVED_HOSTS)})"
_WEAK = f"({_SEG(policy.EXAMPLE_SEGMENTS)}::int + {_HOST}::int + {_any('key', policy.KEY_WORDS)}::int)"


@query("classify_disposition", f"""
with c as ({_policy_rows(DUCK)}), r as (select *, case when {_SEG(policy.TEST_SEGMENTS)} then 'test_path' when regexp_matches({_base('path')}, '\\.(example|sample|template)(\\.|$)') then 'example_path' when contains(upper(value), 'EXAMPLE') or lower(value) in ({', '.join(map(_quote, policy.DUMMIES))}) then 'known_dummy_value'
  when {_any("path || chr(10) || key || chr(10) || line || chr(10) || value", policy.MARKERS)} then 'placeholder_marker' when {_WEAK} >= 2 and {_SEG(policy.EXAMPLE_SEGMENTS)} then 'example_path' when {_WEAK} >= 2 and {_HOST} then 'reserved_host' else '' end as reason from c)
select id, reason, case when reason = '' then 'actionable' else 'example' end as disposition from r""")
def classify_disposition(spark: SparkSession, d: str) -> DataFrame:
    r = i.rows(spark, d, _policy_rows).select("id", policy.example_reason(F.col("path"), F.col("key"), F.col("line"), F.col("value")).alias("reason"))
    return r.withColumn("disposition", F.when(F.col("reason") == "", "actionable").otherwise("example"))


@query("confidence_adjust", f"with c as ({_policy_rows(DUCK)}) select id, base, {_confidence('base', 'path', 'key', 'value')} as confidence from c")
def confidence_adjust(spark: SparkSession, d: str) -> DataFrame:
    return i.rows(spark, d, _policy_rows).select("id", "base", policy.confidence(F.col("base"), F.col("path"), F.col("key"), F.col("value")).alias("confidence"))


# --- scalars over documents --------------------------------------------------------------------------------------------------


def _doc_values(d) -> str:
    """Each whole text, and each of its lines."""
    lines = "unnest(string_split(text, chr(10)))" if d is DUCK else "explode(split(text, '\\n'))"
    return f"select doc_id, text as value from documents union all select doc_id, {lines} as value from documents"


@query("redact_values", f"with c as ({_doc_values(DUCK)}) select doc_id, case when value = '' then '' when contains(value, chr(10)) then string_split(value, chr(10))[1] || '...redacted...' when length(value) <= 6 then repeat('*', length(value)) else left(value, 3) || repeat('*', length(value) - 5) || right(value, 2) end as redacted from c")
def redact_values(spark: SparkSession, d: str) -> DataFrame:
    return i.rows(spark, d, _doc_values).select("doc_id", scalar.redact(F.col("value")).alias("redacted"))


@query("fingerprints", f"with c as ({_doc_values(DUCK)}) select doc_id, sha256(value) as fingerprint from c")
def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return i.rows(spark, d, _doc_values).select("doc_id", scalar.fingerprint(F.col("value")).alias("fingerprint"))


#: spans at the start, at each eighth and at the end of the ASCII part of documents: bytes are characters there
def _spans(d) -> str:
    ascii_part = "regexp_replace(text, '[^ -~\\n]', '?', 'g')" if d is DUCK else "regexp_replace(text, '[^ -~\\\\n]', '?')"
    k, div = ("unnest(range(9))", "//") if d is DUCK else ("explode(sequence(0, 8))", "div")
    return f"select doc_id, text, a, a + w as b from (select doc_id, text, w, cast(greatest(length(text) - w, 0) * k {div} 8 as bigint) as a from (select doc_id, text, w, {k} as k from (select doc_id, {ascii_part} as text, cast(3 + doc_id % 7 as bigint) as w from documents)))"


_TRIM = lambda x: f"regexp_replace(regexp_replace({x}, '^\\s+', ''), '\\s+$', '')"


@query("snippets", f"""
with c as ({_spans(DUCK)}), v as (select *, substr(text, a + 1, b - a) as v, {_TRIM("substr(text, greatest(a - 24, 0) + 1, a - greatest(a - 24, 0))")} as pre, {_TRIM("substr(text, b + 1, 24)")} as post from c where b <= strlen(text))
select doc_id, case when pre <> '' then pre || ' ' else '' end || v || case when post <> '' then ' ' || post else '' end as snippet from v""")
def snippets(spark: SparkSession, d: str) -> DataFrame:
    c = i.rows(spark, d, _spans).withColumn("content", F.col("text").cast("binary")).where("b <= octet_length(content)")
    return c.select("doc_id", scalar.snippet(F.col("content"), F.expr("substring(text, int(a) + 1, int(b - a))"), F.col("a"), F.col("b")).alias("snippet"))


@query("line_numbers", f"with c as ({_spans(DUCK)}) select doc_id, (1 + length(substr(text, 1, a)) - length(replace(substr(text, 1, a), chr(10), '')))::bigint as line_number from c")
def line_numbers(spark: SparkSession, d: str) -> DataFrame:
    c = i.rows(spark, d, _spans).withColumn("content", F.col("text").cast("binary"))
    return c.select("doc_id", scalar.line_number(F.col("content"), F.col("a")).cast("long").alias("line_number"))


@query("match_lines", f"with c as ({_spans(DUCK)}) select doc_id, regexp_extract(substr(text, 1, a), '([^\\n]*)$', 1) || substr(text, a + 1, b - a) || string_split(substr(text, b + 1), chr(10))[1] as line from c where b <= strlen(text)")
def match_lines(spark: SparkSession, d: str) -> DataFrame:
    c = i.rows(spark, d, _spans).withColumn("content", F.col("text").cast("binary")).where("b <= octet_length(content)")
    return c.select("doc_id", scalar.match_line(F.col("content"), F.col("a"), F.col("b")).alias("line"))


@query("source_locations", f"with c as ({_policy_rows(DUCK)}) select id, 'env:' || case when trim(path) <> '' then path when trim(key) <> '' then key else 'env' end as location from c")
def source_locations(spark: SparkSession, d: str) -> DataFrame:
    return i.rows(spark, d, _policy_rows).select("id", scalar.source_location(F.lit("env"), F.col("path"), F.col("key")).alias("location"))


@query("value_entropy", "select c_custkey as id, round(list_entropy(string_split(c_name, '')), 6) as entropy from customer")
def value_entropy(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("id"), F.round(scalar.entropy(F.col("c_name")), 6).alias("entropy"))


@query("classify_content", "with c as (select doc_id, text, length(text) as n, length(regexp_replace(text, '[^\\n\\r\\t\\p{L}\\p{M}\\p{N}\\p{P}\\p{S} ]', '', 'g')) as good from documents) select doc_id, case when n = 0 then 'text' when good < 0.85 * n then 'binary_low_printable' else 'text' end as content_class from c")
def classify_content(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", layers.text_class(F.col("text")).alias("content_class"))


# --- findings ----------------------------------------------------------------------------------------------------------------

_ORDER = ", ".join(fnd.ORDER)
_DETAIL_ORDER = ", ".join(fnd.DETAIL_ORDER)
_REST = ", ".join(c for c in fnd.DETAIL if c not in fnd.DETAIL_ORDER)
_FIRST = "case when trim({0}) <> '' then {0} else {1} end"


@query("dedup_public", f"with f as (select distinct {', '.join(fnd.PUBLIC)} from ({i.finding_rows(DUCK)})), r as (select *, row_number() over (partition by manifest_digest, disposition, source_type || ':' || case when file_path <> '' then file_path when key <> '' then key else source_type end, line_number, {_FIRST.format('context_snippet', 'fingerprint')} order by {_ORDER}, {', '.join(c for c in fnd.PUBLIC if c not in fnd.ORDER)}) as k from f) select {', '.join(fnd.PUBLIC)} from r where k = 1")
def dedup_public(spark: SparkSession, d: str) -> DataFrame:
    return fnd.dedup_public(fnd.public(i.rows(spark, d, i.finding_rows)))


@query("dedup_detailed", f"with f as ({i.finding_rows(DUCK)}), r as (select *, row_number() over (partition by manifest_digest, disposition, source_location, line_number, match_start, match_end, {_FIRST.format('raw_snippet', _FIRST.format('context_snippet', 'fingerprint'))} order by {_DETAIL_ORDER}, {_REST}) as k from f) select {', '.join(fnd.DETAIL)} from r where k = 1")
def dedup_detailed(spark: SparkSession, d: str) -> DataFrame:
    return fnd.dedup_detailed(i.rows(spark, d, i.finding_rows).select(*fnd.DETAIL))


@query("unique_fingerprints", f"with f as ({i.finding_rows(DUCK)}) select manifest_digest, disposition, count(*) as findings, count(distinct fingerprint) as fingerprints from f group by all")
def unique_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    f = i.rows(spark, d, i.finding_rows)
    return f.groupBy("manifest_digest", "disposition").agg(F.count("*").alias("findings"), fnd.unique_fingerprints(f).alias("fingerprints"))


@query("split_dispositions", f"with f as ({i.finding_rows(DUCK)}) select case when disposition = 'actionable' then 'actionable' else 'suppressed' end as part, detector_name, count(*) as findings from f group by all")
def split_dispositions(spark: SparkSession, d: str) -> DataFrame:
    one, two = fnd.split(i.rows(spark, d, i.finding_rows))
    both = one.withColumn("part", F.lit("actionable")).unionByName(two.withColumn("part", F.lit("suppressed")))
    return both.groupBy("part", "detector_name").agg(F.count("*").alias("findings"))


_CAP = ", ".join(fnd.CAP_KEY)


@query("cap_low_confidence", f"with f as (select distinct {', '.join(fnd.DETAIL)} from ({i.finding_rows(DUCK)})), r as (select *, row_number() over (partition by {_CAP} order by {_DETAIL_ORDER}, {_REST}) as k, count(*) over (partition by {_CAP}) as n from f) select {', '.join(fnd.DETAIL)}, (case when confidence = 'low' and file_path <> '' and k = 1 then n else 0 end)::bigint as occurrence_count, (case when confidence = 'low' and file_path <> '' and k = 1 then greatest(n - 3, 0) else 0 end)::bigint as suppressed_occurrence_count from r where not (confidence = 'low' and file_path <> '') or k <= 3")
def cap_low_confidence(spark: SparkSession, d: str) -> DataFrame:
    return fnd.cap_low_confidence(i.rows(spark, d, i.finding_rows).select(*fnd.DETAIL).distinct(), fnd.DETAIL_ORDER + [c for c in fnd.DETAIL if c not in fnd.DETAIL_ORDER])


@query("error_summaries", "with e as (select distinct o_custkey as id, o_orderpriority as m, min(o_orderkey) over (partition by o_custkey, o_orderpriority) as k from orders) select id, array_to_string(list(m order by k)[1:3], '; ') as messages from e group by id")
def error_summaries(spark: SparkSession, d: str) -> DataFrame:
    return fnd.first_messages(spark.read.parquet(f"{d}/orders.parquet").withColumnRenamed("o_custkey", "id"), ["id"], F.col("o_orderpriority"), F.col("o_orderkey"))


# --- metadata ----------------------------------------------------------------------------------------------------------------


def _cfg(spark: SparkSession, d: str) -> DataFrame:
    return meta.parse_configs(i.rows(spark, d, i.config_rows)).drop("body")


def _flat(df: DataFrame) -> DataFrame:
    return df.select("id", "source_type", "key", "match_key", "content")


@query("flatten_env", f"with c as ({i.config_rows(DUCK)}), e as (select id, unnest(list_sort(json_extract_string(body, '$.config.Env[*]'))) as content from c) select id, 'env' as source_type, trim(string_split(content, '=')[1]) as key, string_split(content, '=')[1] as match_key, content from e")
def flatten_env(spark: SparkSession, d: str) -> DataFrame:
    return _flat(meta.flatten_env(_cfg(spark, d)))


@query("flatten_labels", f"with c as ({i.config_rows(DUCK)}), e as (select id, unnest(json_keys(body, '$.config.Labels')) as key, body from c) select id, 'label' as source_type, key, key as match_key, key || '=' || json_extract_string(body, '$.config.Labels.' || key) as content from e")
def flatten_labels(spark: SparkSession, d: str) -> DataFrame:
    return _flat(meta.flatten_labels(_cfg(spark, d)))


@query("flatten_history", f"with c as ({i.config_rows(DUCK)}), h as (select id, body, unnest(range(json_array_length(body, '$.history')::bigint)) as n from c), f as (select id, n, unnest(['created_by', 'comment', 'author']) as f, body from h), v as (select id, 'history[' || n || '].' || f as key, json_extract_string(body, '$.history[' || n || '].' || f) as content from f) select id, 'history' as source_type, key, key as match_key, content from v where trim(coalesce(content, '')) <> ''")
def flatten_history(spark: SparkSession, d: str) -> DataFrame:
    return _flat(meta.flatten_history(_cfg(spark, d)))


@query("flatten_config", f"""with c as ({i.config_rows(DUCK)}), v as (
  select id, 'author' as key, json_extract_string(body, '$.author') as content from c
  union all select id, 'config.hostname', json_extract_string(body, '$.config.Hostname') from c union all select id, 'config.user', json_extract_string(body, '$.config.User') from c union all select id, 'config.working_dir', json_extract_string(body, '$.config.WorkingDir') from c
  union all select id, 'config.cmd[' || n || ']', json_extract_string(body, '$.config.Cmd[' || n || ']') from (select id, body, unnest(range(2)) as n from c)
  union all select id, 'config.exposed_ports', unnest(json_keys(body, '$.config.ExposedPorts')) from c)
select id, 'config' as source_type, key, key as match_key, trim(content) as content from v where trim(content) <> ''""")
def flatten_config(spark: SparkSession, d: str) -> DataFrame:
    return _flat(meta.flatten_config(_cfg(spark, d)))


def _index_rows(d) -> str:
    one = lambda n, os, arch, extra="": f"""{{"mediaType":"application/vnd.oci.image.manifest.v1+json","digest":"sha256:' || c_custkey || '-{n}","size":7{extra},"platform":{{"os":"{os}","architecture":"{arch}"}}}}"""
    parts = ",".join([one(1, "linux", "amd64"), one(2, "Linux", "ARM64"), one(3, "unknown", "unknown"), one(4, "windows", "amd64", ',"annotations":{"vnd.docker.reference.type":"attestation-manifest"}'), one(5, "linux", "s390x", ',"artifactType":"x"')])
    return f"select c_custkey as id, case when c_custkey % 4 = 0 then '{{\"mediaType\":\"application/vnd.oci.image.manifest.v1+json\",\"layers\":[]}}' else '{{\"manifests\":[{parts}]}}' end as body, 'application/vnd.oci.image.index.v1+json; charset=utf-8' as header_type from customer"


@query("parse_documents", f"with c as ({_index_rows(DUCK)}) select id, case when id % 4 = 0 then 'manifest' else 'index' end as kind, case when id % 4 = 0 then 'application/vnd.oci.image.manifest.v1+json' else 'application/vnd.oci.image.index.v1+json' end as media_type from c")
def parse_documents(spark: SparkSession, d: str) -> DataFrame:
    return meta.parse_documents(i.rows(spark, d, _index_rows)).select("id", "kind", "media_type")


@query("select_descriptors", f"with c as ({_index_rows(DUCK)}) select id, 'sha256:' || id || '-' || n as digest from (select id, unnest([1, 2]) as n from c where id % 4 <> 0)")
def select_descriptors(spark: SparkSession, d: str) -> DataFrame:
    return meta.select_descriptors(meta.parse_documents(i.rows(spark, d, _index_rows))).select("id", F.col("d.digest").alias("digest"))


@query("platform_match", f"with c as ({_index_rows(DUCK)}) select id, 'sha256:' || id || '-2' as digest from c where id % 4 <> 0")
def platform_match(spark: SparkSession, d: str) -> DataFrame:
    return meta.select_descriptors(meta.parse_documents(i.rows(spark, d, _index_rows)), ref.parse_platform("linux/arm64")).select("id", F.col("d.digest").alias("digest"))


def _reference_rows(d) -> str:
    return "select c_custkey as id, case cast(c_custkey % 8 as int) when 0 then 'nginx' when 1 then 'org/app:1.' || c_custkey when 2 then 'ghcr.io/o/a@sha256:' || c_custkey when 3 then 'localhost:5000/x:y' when 4 then 'index.docker.io/nginx' when 5 then 'http://bad' when 6 then 'a:' else ' Reg.IO/p/q:t@sha256:1 ' end as raw from customer"


@query("parse_references", f"""with c as ({_reference_rows(DUCK)}), r as (select id, cast(id % 8 as int) as k from c)
select id, case k when 0 then 'docker.io' when 1 then 'docker.io' when 2 then 'ghcr.io' when 3 then 'localhost:5000' when 4 then 'docker.io' when 7 then 'reg.io' end as registry, case k when 0 then 'library/nginx' when 1 then 'org/app' when 2 then 'o/a' when 3 then 'x' when 4 then 'library/nginx' when 7 then 'p/q' end as repository,
  case k when 1 then '1.' || id when 3 then 'y' when 7 then 't' when 5 then null when 6 then null else '' end as tag, case k when 2 then 'sha256:' || id when 7 then 'sha256:1' when 5 then null when 6 then null else '' end as digest,
  case k when 0 then 'latest' when 1 then '1.' || id when 2 then 'sha256:' || id when 3 then 'y' when 4 then 'latest' when 7 then 'sha256:1' end as identifier,
  case k when 0 then 'docker.io/library/nginx:latest' when 1 then 'docker.io/org/app:1.' || id when 2 then 'ghcr.io/o/a@sha256:' || id when 3 then 'localhost:5000/x:y' when 4 then 'docker.io/library/nginx:latest' when 7 then 'reg.io/p/q@sha256:1' end as canonical from r""")
def parse_references(spark: SparkSession, d: str) -> DataFrame:
    return i.rows(spark, d, _reference_rows).select("id", *[c.alias(k) for k, c in ref.columns(F.col("raw")).items()])


# --- replay ------------------------------------------------------------------------------------------------------------------


def _replay(spark: SparkSession, d: str, links: bool = False) -> DataFrame:
    r = i.rows(spark, d, i.replay_rows)
    name = F.when(F.col("op") == "opaque", rep.OPAQUE).when(F.col("op") == "whiteout", F.concat(F.lit(rep.PREFIX), "name")).otherwise(F.col("name"))
    layer = F.coalesce(F.concat(F.lit("l"), "img", F.lit("-"), "layer_idx"), F.lit(""))  # never null: else the join computes it once more to test that
    kind = F.when(F.lit(links) & (F.col("op") == "put") & (F.col("entry_idx") % 5 == 0), "hardlink").otherwise(F.col("kind"))
    e = r.select(layer.alias("layer_digest"), "entry_idx", F.concat("dir", F.lit("/"), name).alias("path"), kind.alias("kind"), F.lit("app/d1/f1").alias("linkname"))
    ml = r.select("img", "layer_idx").distinct().select(F.concat(F.lit("m"), "img").alias("manifest_digest"), "layer_idx", layer.alias("layer_digest"))
    return rep.replay(F.broadcast(ml), e)  # 200 images of 6 layers at every size


_REPLAY = f"""
with e as (select *, layer_idx * 1000000 + entry_idx as seq, dir || '/' || name as path, 'l' || img || '-' || layer_idx as layer from ({i.replay_rows(DUCK)})),
n as (select *, lead(seq) over (partition by manifest_digest, path order by seq) as nxt from e where op <> 'opaque'),
o as (select n.manifest_digest, n.seq, min(x.seq) as swept from n join e x on x.op = 'opaque' and x.manifest_digest = n.manifest_digest and x.dir = n.dir and x.seq > n.seq where n.op = 'put' group by 1, 2),
u as (select n.*, least(n.nxt, o.swept) as until from n left join o on o.manifest_digest = n.manifest_digest and o.seq = n.seq where n.op = 'put')
select manifest_digest, path, kind, layer as layer_digest, entry_idx, case when until is null then '' else 'l' || img || '-' || (until // 1000000) end as deleted_by from u where kind <> 'symlink'"""


@query("replay_final", f"select manifest_digest, path, kind, layer_digest, entry_idx from ({_REPLAY}) where deleted_by = ''")
def replay_final(spark: SparkSession, d: str) -> DataFrame:
    return _replay(spark, d).where("state = 'final'").select("manifest_digest", "path", "kind", "layer_digest", "entry_idx")


@query("replay_deleted", f"select * from ({_REPLAY}) where deleted_by <> ''")
def replay_deleted(spark: SparkSession, d: str) -> DataFrame:
    return _replay(spark, d).where("state = 'deleted'").select("manifest_digest", "path", "kind", "layer_digest", "entry_idx", "deleted_by")


# a link at the target itself doesn't change whether the target is live, so its source is the last plain put since the last delete
_TARGET = "manifest_digest order by seq rows between unbounded preceding and 1 preceding"
_LINKS = f"""
with e0 as (select *, layer_idx * 1000000 + entry_idx as seq, dir || '/' || name as path, 'l' || img || '-' || layer_idx as layer, op = 'put' and entry_idx % 5 = 0 as link from ({i.replay_rows(DUCK)})),
e1 as (select *, max(case when op = 'put' and not link and path = 'app/d1/f1' then seq end) over (partition by {_TARGET}) as src, max(case when op = 'opaque' and dir = 'app/d1' or op = 'whiteout' and path = 'app/d1/f1' then seq end) over (partition by {_TARGET}) as cut from e0),
e as (select * replace (case when link then 'hardlink' else kind end as kind) from e1 where not link or (src is not null and (cut is null or cut < src))),
n as (select *, lead(seq) over (partition by manifest_digest, path order by seq) as nxt from e where op <> 'opaque'),
o as (select n.manifest_digest, n.seq, min(x.seq) as swept from n join e x on x.op = 'opaque' and x.manifest_digest = n.manifest_digest and x.dir = n.dir and x.seq > n.seq where n.op = 'put' group by 1, 2),
u as (select n.*, least(n.nxt, o.swept) as until from n left join o on o.manifest_digest = n.manifest_digest and o.seq = n.seq where n.op = 'put')
select manifest_digest, path, kind, layer as layer_digest, entry_idx, case when link then 'l' || img || '-' || (src // 1000000) else layer end as src_layer, case when link then (src % 1000000)::int else entry_idx end as src_entry,
  case when until is null then 'final' else 'deleted' end as state, case when until is null then '' else 'l' || img || '-' || (until // 1000000) end as deleted_by from u where kind <> 'symlink'"""


@query("replay_hardlinks", _LINKS)
def replay_hardlinks(spark: SparkSession, d: str) -> DataFrame:
    return _replay(spark, d, links=True)


# --- state -------------------------------------------------------------------------------------------------------------------


def _at(d=DUCK) -> str:
    return d.day("10")


def _now():
    return F.expr(i.SPARK.day("10"))


def _upsert_sql(table: str, keys: list[str], cols: list[str], update: dict[str, str], id_: str = "") -> str:
    on = " and ".join(f"o.{k} = n.{k}" for k in keys)
    fixed = {"first_seen_at": _at(), "last_seen_at": _at()}
    out = []
    for c in cols:
        new = fixed.get(c) or f"n.{c}"
        up = _at() if c == "last_seen_at" else update.get(c)
        old = f"case when n.{keys[0]} is not null then {up} else o.{c} end" if up else f"o.{c}"
        out.append(f"case when o.{keys[0]} is not null then {old} else {new} end as {c}")
    return f"with o as ({i.state_rows(table, 'old')(DUCK)}), n as ({i.state_rows(table, 'new')(DUCK)}) select {', '.join(out)} from o full join n on {on}"


def _pair(spark: SparkSession, d: str, table: str) -> tuple[DataFrame, DataFrame]:
    return i.rows(spark, d, i.state_rows(table, "old")), i.rows(spark, d, i.state_rows(table, "new"))


_SEEN = ["first_seen_at", "last_seen_at"]


@query("upsert_repositories", _upsert_sql("repositories", ["registry", "repository"], ["registry", "repository", *_SEEN], {}))
def upsert_repositories(spark: SparkSession, d: str) -> DataFrame:
    return state.upsert_repositories(*_pair(spark, d, "repositories"), _now()).drop("id")


@query("upsert_manifests", _upsert_sql("manifests", ["digest"], ["digest", "platform_os", "platform_architecture", "platform_variant", *_SEEN, "last_scan_status", "last_scan_error"], {c: f"case when n.{c} <> '' then n.{c} else o.{c} end" for c in ("platform_os", "platform_architecture", "platform_variant")} | {"last_scan_status": "n.last_scan_status", "last_scan_error": "n.last_scan_error"}))
def upsert_manifests(spark: SparkSession, d: str) -> DataFrame:
    return state.upsert_manifests(*_pair(spark, d, "manifests"), _now())


@query("upsert_repository_manifests", _upsert_sql("repository_manifests", ["repository_id", "manifest_digest"], ["repository_id", "manifest_digest", "root_digest", *_SEEN, "last_scan_status", "last_scan_error"], {c: f"n.{c}" for c in ("root_digest", "last_scan_status", "last_scan_error")}))
def upsert_repository_manifests(spark: SparkSession, d: str) -> DataFrame:
    return state.upsert_repository_manifests(*_pair(spark, d, "repository_manifests"), _now())


@query("replace_tags", f"with o as ({i.state_rows('tags', 'old')(DUCK)}), n as ({i.state_rows('tags', 'new')(DUCK)}) select * from o where (repository_id, tag) not in (select repository_id, tag from n) union all select *, {_at()}, {_at()} from n")
def replace_tags(spark: SparkSession, d: str) -> DataFrame:
    return state.replace_tags(*_pair(spark, d, "tags"), _now())


@query("upsert_findings", _upsert_sql("findings", ["manifest_digest", "fingerprint"], ["manifest_digest", "fingerprint", "redacted_value", "value", *_SEEN], {"redacted_value": "n.redacted_value", "value": "n.value"}))
def upsert_findings(spark: SparkSession, d: str) -> DataFrame:
    return state.upsert_findings(*_pair(spark, d, "findings"), _now()).drop("id")


_OCC = ["finding_id", "source_key", "context_snippet", "match_start", "match_end", "present_in_final_image", *_SEEN, "disposition", "disposition_reason", "line_number"]


@query("upsert_occurrences", _upsert_sql("finding_occurrences", ["finding_id", "source_key", "match_start", "present_in_final_image"], _OCC, {c: f"n.{c}" for c in ("disposition", "disposition_reason", "line_number")}))
def upsert_occurrences(spark: SparkSession, d: str) -> DataFrame:
    return state.upsert_occurrences(*_pair(spark, d, "finding_occurrences"), _now()).select(*_OCC)


@query("append_scan_runs", f"with r as ({i.run_rows(DUCK)}) select repository_id, count(*) as runs, max(scanned_at) as last_at from (select * from r where id % 2 = 0 union all select * from r where id % 2 = 1) group by 1")
def append_scan_runs(spark: SparkSession, d: str) -> DataFrame:
    r = i.rows(spark, d, i.run_rows)
    return state.append_runs(r.where("id % 2 = 0"), r.where("id % 2 = 1")).groupBy("repository_id").agg(F.count("*").alias("runs"), F.max("scanned_at").alias("last_at"))


@query("group_tags_by_digest", "select 'sha256:' || o_custkey as digest, array_to_string(list_sort(list(distinct o_orderkey::varchar)), ',') as tags, min(o_orderkey::varchar) as first_tag, count(distinct o_orderkey)::bigint as tag_count from orders group by o_custkey")
def group_tags_by_digest(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.concat(F.lit("sha256:"), "o_custkey").alias("digest"), F.col("o_orderkey").cast("string").alias("tag"))
    return state.group_tags(o).withColumn("tags", F.array_join("tags", ","))


def _scanned_rows(d) -> str:
    m = lambda n: f"{{'digest': 'sha256:' || o_custkey || '-{n}', 'os': 'linux', 'architecture': 'a{n}', 'variant': '', 'status': 'scanned', 'error': ''}}" if d is DUCK else f"named_struct('digest', 'sha256:' || o_custkey || '-{n}', 'os', 'linux', 'architecture', 'a{n}', 'variant', '', 'status', 'scanned', 'error', '')"
    return f"select {d.list("'t' || o_orderkey", "'u' || (o_orderkey % 7)")} as tags, 'sha256:' || o_custkey as root_digest, {d.list(m(1), m(2))} as manifests, o_orderkey % 5 = 0 as bad, o_orderkey from orders"


@query("tag_records", f"with t as ({_scanned_rows(DUCK)}), x as (select unnest(tags) as tag, root_digest, manifests from t where not bad), y as (select tag, root_digest, unnest(manifests) as m from x) select distinct tag, root_digest, m.digest as manifest_digest, m.os as platform_os, m.architecture as platform_architecture, m.variant as platform_variant, m.status as status, m.error as error from y union select 't' || o_orderkey, '', '', '', '', '', 'failed', 'gone' from t where bad")
def tag_records(spark: SparkSession, d: str) -> DataFrame:
    t = i.rows(spark, d, _scanned_rows)
    return state.tag_records(t.where("not bad"), t.where("bad").select(F.concat(F.lit("t"), "o_orderkey").alias("tag"), F.lit("gone").alias("error")))


def _record_rows(d) -> str:
    return "select 'sha256:' || (l_partkey % 300) as digest, case when l_linenumber % 3 = 0 then 'root' || l_orderkey else '' end as root_digest, case when l_suppkey % 2 = 0 then 'linux' else '' end as platform_os, case when l_suppkey % 3 = 0 then 'a' || l_linenumber else '' end as platform_architecture, '' as platform_variant, case when l_partkey % 300 < 200 and l_quantity < 40 or l_partkey % 300 >= 290 then 'failed' else 'scanned' end as status, case when l_partkey % 300 < 200 and l_quantity < 40 then 'e' || l_orderkey else '' end as error, l_orderkey * 10 + l_linenumber as ord from lineitem"


@query("manifest_merge", f"""with r as ({_record_rows(DUCK)}), g as (select digest, arg_min(case when root_digest = '' then digest else root_digest end, ord) as root_digest, coalesce(arg_min(platform_os, ord) filter (platform_os <> ''), '') as platform_os, coalesce(arg_min(platform_architecture, ord) filter (platform_architecture <> ''), '') as platform_architecture, '' as platform_variant, bool_or(status = 'scanned') as ok, arg_min(status, ord) as s, arg_max(error, ord) filter (error <> '') as e from r group by digest)
select digest, root_digest, platform_os, platform_architecture, platform_variant, case when ok then 'scanned' else s end as status, case when ok then '' else coalesce(e, '') end as error from g""")
def manifest_merge(spark: SparkSession, d: str) -> DataFrame:
    return state.merge_manifests(i.rows(spark, d, _record_rows))


@query("run_status", "select o_orderkey as id, case when o_orderkey % 3 = 0 and o_orderkey % 2 = 0 then 'partial' when o_orderkey % 3 = 0 then 'failed' when o_orderkey % 5 > 3 then 'partial' else 'completed' end as status from orders")
def run_status(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return spark.read.parquet(f"{d}/orders.parquet").select(k.alias("id"), state.run_status(F.when(k % 3 == 0, "boom").otherwise(" "), k % 2 == 0, F.when(k % 5 > 3, 1).otherwise(0)).alias("status"))


# --- read queries ------------------------------------------------------------------------------------------------------------


def _tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {"repositories": i.rows(spark, d, i.repo_rows), "scan_runs": i.rows(spark, d, i.run_rows), "repository_manifests": i.rows(spark, d, i.repo_manifest_rows), "findings": i.rows(spark, d, i.stored_finding_rows), "finding_occurrences": i.rows(spark, d, i.stored_occurrence_rows)}


_WITH = f"with repositories as ({i.repo_rows(DUCK)}), scan_runs as ({i.run_rows(DUCK)}), repository_manifests as ({i.repo_manifest_rows(DUCK)}), findings as ({i.stored_finding_rows(DUCK)}), occ as ({i.stored_occurrence_rows(DUCK)})"
_RUN = ", ".join("r." + c if c in ("registry", "repository") else "s." + c for c in api.RUN)


@query("list_repositories", f"{_WITH} select registry, repository, first_seen_at, last_seen_at from repositories order by last_seen_at desc, repository, registry limit 10 offset 5")
def list_repositories(spark: SparkSession, d: str) -> DataFrame:
    return api.list_repositories(_tables(spark, d), 10, 5)


@query("list_repository_scans", f"{_WITH} select {_RUN} from scan_runs s join repositories r on r.id = s.repository_id where r.registry = 'docker.io' and r.repository = 'library/nation_1' order by s.scanned_at desc, s.id desc limit 50")
def list_repository_scans(spark: SparkSession, d: str) -> DataFrame:
    return api.list_scans(_tables(spark, d), "", "library/nation_1")


_COUNTS = "count(*) as occurrence_count, count(*) filter (o.disposition = 'actionable') as actionable_occurrence_count, count(*) filter (o.disposition = 'example') as suppressed_occurrence_count, array_to_string(list_sort(list(distinct o.detector_name)), ',') as detectors"


def _list(which: str) -> None:
    having = {"actionable": "having count(*) filter (o.disposition = 'actionable') > 0", "suppressed": "having count(*) filter (o.disposition = 'example') > 0", "all": ""}[which]
    sql = f"{_WITH} select f.id, f.manifest_digest, f.fingerprint, f.redacted_value, f.first_seen_at, f.last_seen_at, {_COUNTS} from repositories r join repository_manifests m on m.repository_id = r.id join findings f on f.manifest_digest = m.manifest_digest join occ o on o.finding_id = f.id where r.registry = 'docker.io' and r.repository = 'library/nation_2' group by all {having} order by f.last_seen_at desc, f.id desc limit 200"
    query(f"list_repository_findings_{which}", sql)(lambda spark, d: api.list_findings(_tables(spark, d), "docker.io", "library/nation_2", which, 500).withColumn("detectors", F.array_join("detectors", ",")))


for _which in ("actionable", "suppressed", "all"):
    _list(_which)


@query("get_scan_run", f"{_WITH} select {_RUN}, s.result_json from scan_runs s join repositories r on r.id = s.repository_id where s.id = 7")
def get_scan_run(spark: SparkSession, d: str) -> DataFrame:
    return api.get_scan(_tables(spark, d), 7)


@query("get_finding", f"{_WITH} select f.id, f.manifest_digest, f.fingerprint, f.redacted_value, f.first_seen_at, f.last_seen_at, {_COUNTS} from findings f join occ o on o.finding_id = f.id where f.id = 5 group by all")
def get_finding(spark: SparkSession, d: str) -> DataFrame:
    return api.get_finding(_tables(spark, d), 5)[0].withColumn("detectors", F.array_join("detectors", ","))


@query("get_finding_occurrences", f"{_WITH} select {', '.join(api.OCCURRENCE)} from occ where finding_id = 5")
def get_finding_occurrences(spark: SparkSession, d: str) -> DataFrame:
    return api.get_finding(_tables(spark, d), 5)[1]


# --- small functions ---------------------------------------------------------------------------------------------------------


@query("registry_urls", f"with c as ({_reference_rows(DUCK)}) select id, case id % 8 when 2 then 'https://ghcr.io' when 3 then 'http://localhost:5000' when 7 then 'https://reg.io' when 5 then null when 6 then null else 'https://registry-1.docker.io' end as url from c")
def registry_urls(spark: SparkSession, d: str) -> DataFrame:
    return i.rows(spark, d, _reference_rows).select("id", ref.base_url(ref.columns(F.col("raw"))["registry"]).alias("url")).withColumn("url", F.when(F.col("url") != "", F.col("url")))


_LAYER_TYPES = {"none": meta.PLAIN_LAYERS, "gzip": meta.GZIP_LAYERS, "zstd": meta.ZSTD_LAYERS, "foreign": meta.FOREIGN_LAYERS}
_ALL_TYPES = [t for ts in _LAYER_TYPES.values() for t in ts] + ["text/plain"]


def _type_rows(d) -> str:
    arms = " ".join(f"when {n} then '{t}'" for n, t in enumerate(_ALL_TYPES))
    return f"select p_partkey as id, case cast(p_partkey % {len(_ALL_TYPES)} as int) {arms} end || case when p_partkey % 2 = 0 then '; q=1' else '' end as media_type from part"


@query("layer_compression", f"with c as ({_type_rows(DUCK)}), t as (select id, trim(string_split(media_type, ';')[1]) as t from c) select id, case {' '.join(f"when t in ({', '.join(map(_quote, ts))}) then '{k}'" for k, ts in _LAYER_TYPES.items())} else 'unknown' end as compression from t")
def layer_compression(spark: SparkSession, d: str) -> DataFrame:
    return i.rows(spark, d, _type_rows).select("id", meta.compression(meta.media_type(F.col("media_type"))).alias("compression"))


@query("platform_names", "select p_partkey as id, case when p_partkey % 5 = 0 then '' else 'linux/' || case when p_partkey % 3 = 0 then 'arm64/v8' else 'amd64' end end as platform from part")
def platform_names(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    known = k % 5 != 0
    return spark.read.parquet(f"{d}/part.parquet").select(k.alias("id"), scalar.platform_name(F.when(known, " Linux"), F.when(known, F.when(k % 3 == 0, "ARM64").otherwise("amd64")), F.when(known & (k % 3 == 0), "v8")).alias("platform"))


@query("file_name_tokens", "select p_partkey as id, regexp_replace(regexp_replace(lower(trim(p_name || '/' || p_brand || ':' || p_partkey)), '[^a-z0-9._-]+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g') as token from part")
def file_name_tokens(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), scalar.path_token(F.concat("p_name", F.lit("/"), "p_brand", F.lit(":"), "p_partkey")).alias("token"))


@query("utc_stamps", f"with r as ({i.run_rows(DUCK)}) select id, strftime(scanned_at, '%Y-%m-%dT%H:%M:%SZ') as stamp from r")
def utc_stamps(spark: SparkSession, d: str) -> DataFrame:
    return i.rows(spark, d, i.run_rows).select("id", scalar.rfc3339(F.col("scanned_at")).alias("stamp"))


@query("invalid_records", f"with r as (select case when c_custkey % 6 = 0 then ' ' else 'docker.io' end as registry, case when c_custkey % 10 = 1 then null else 'r' || c_custkey end as repository from customer) select * from r where repository is null or trim(registry) = ''")
def invalid_records(spark: SparkSession, d: str) -> DataFrame:
    return state.invalid("repositories", i.rows(spark, d, lambda _: "select case when c_custkey % 6 = 0 then ' ' else 'docker.io' end as registry, case when c_custkey % 10 = 1 then null else 'r' || c_custkey end as repository from customer"))


@query(
    "documents_candidate_verdicts",
    f"""with l as (select doc_id, unnest(string_split(text, chr(10))) as line from documents), c as (select doc_id, line, unnest(regexp_extract_all(line, {_re2(rules.CANDIDATE)})) as v from l where regexp_matches(lower(line), {_re2(s.KEYWORDS.decode())})),
p as (select doc_id, v, substr(line, 1, instr(line, v) - 1) as pre from c)
select doc_id, v as value, case when not (regexp_matches(pre, '(=|:|=>)["\\x60]*\\s*$') and regexp_matches(right(lower(pre), 96), {_re2(s.KEYWORDS.decode())})) then 'no_context' when list_entropy(string_split(v, '')) < 3.75 then 'low_entropy' else '' end as verdict from p""",
)
def documents_candidate_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Candidates in the real texts, whose assignments have a space before the quote."""
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.col("text").alias("content"), F.lit("").alias("key"))
    return det.entropy_candidates(rows).select("doc_id", F.col("value").cast("string").alias("value"), "verdict")


# --- runs and saved state, through the functions that scans use ------------------------------------------------------------------


def _target_rows(d) -> str:
    """Root documents times their manifests; some roots have none, some manifests failed."""
    return "select 'r' || (l_orderkey % 400) as root_digest, case when l_orderkey % 40 = 7 then '' else 'm' || (l_partkey % 300) end as digest, case when l_orderkey % 40 = 7 or l_orderkey % 40 = 9 or l_partkey % 11 = 0 then 'failed' else 'scanned' end as status from lineitem"


@query("target_counters", f"""
with t as ({_target_rows(DUCK)}), p as (select root_digest, count(*) filter (digest <> '') as n, count(*) filter (status = 'scanned') as ok, count(*) filter (digest <> '' and status <> 'scanned') as bad from t group by 1)
select count(*) as target_count, count(*) filter (ok > 0) as completed_target_count, count(*) filter (ok = 0) as failed_target_count, sum(n)::bigint as manifest_count, sum(ok)::bigint as completed_manifest_count, sum(bad)::bigint as failed_manifest_count from p""")
def target_counters(spark: SparkSession, d: str) -> DataFrame:
    return scan.target_counts(i.rows(spark, d, _target_rows))


def _resolved_rows(d) -> str:
    return "select case when o_orderkey % 50 = 0 then '' else 't' || o_orderkey end as tag, case when o_orderkey % 7 = 0 then 'status 404' else '' end as error from orders"


@query("tag_counters", f"with t as ({_resolved_rows(DUCK)}) select count(*) filter (tag <> '') as tags_enumerated, count(*) filter (tag <> '' and error = '') as tags_resolved, count(*) filter (tag <> '' and error <> '') as tags_failed from t")
def tag_counters(spark: SparkSession, d: str) -> DataFrame:
    return jobs.tag_counts(i.rows(spark, d, _resolved_rows))


def _platform_rows(d) -> str:
    part = lambda name, n: f"case cast(c_custkey % {n} as int) when 0 then '' when 1 then ' ' when 2 then null else '{name}' || (c_custkey % 3) end"
    return f"select c_custkey as id, {part('os', 4)} as os, {part('arch', 5)} as architecture, {part('v', 6)} as variant, 'linux' as cos, case when c_custkey % 2 = 0 then 'amd64' else '' end as carch, cast(null as varchar(9)) as cvar from customer"


@query("fill_platform", f"""
with c as ({_platform_rows(DUCK)})
select id, case when trim(coalesce(os, '')) <> '' then os else coalesce(cos, '') end as os, case when trim(coalesce(architecture, '')) <> '' then architecture else coalesce(carch, '') end as architecture, case when trim(coalesce(variant, '')) <> '' then variant else coalesce(cvar, '') end as variant from c""")
def fill_platform(spark: SparkSession, d: str) -> DataFrame:
    c = i.rows(spark, d, _platform_rows).select("id", F.struct("os", "architecture", "variant").alias("d"), F.struct(F.col("cos").alias("os"), F.col("carch").alias("architecture"), F.col("cvar").alias("variant")).alias("g"))
    filled = meta.filled_platform(F.col("d"), F.col("g"))
    return c.select("id", *[F.coalesce(v, F.lit("")).alias(k) for k, v in filled.items()])


def _repeated_rows(d) -> str:
    url = f"'https://u' || c_custkey || ':' || {i.HEX(d, 'rep', 1, 10)} || '@h.io'"
    return f"select c_custkey as content_id, 'one ' || {url} || ' two ' || {url} || ' end' as content, '' as file_path, '' as key from customer"


@query("match_locations", f"""
with c as ({_repeated_rows(DUCK)}), v as (select *, regexp_extract(content, 'https://[^ ]+', 0) as v from c)
select content_id, 'uri' as detector_name, v as value, x.a::bigint as match_start, (x.a + strlen(v))::bigint as match_end, 'medium' as confidence, 2::int as priority from (select *, unnest([4, 4 + strlen(v) + 5]) as a from v) x""")
def match_locations(spark: SparkSession, d: str) -> DataFrame:
    """A value that occurs twice is found at both places."""
    return _matches(det.detect(i.rows(spark, d, _repeated_rows), {"keyword_library"}))


def _saved_rows(d) -> str:
    return "select 'sha256:' || c_custkey as digest, 'sha256:root' || (c_custkey % 9) as root_digest, 'linux' as platform_os, case when c_custkey % 2 = 0 then 'amd64' else 'arm64' end as platform_architecture, '' as platform_variant, case when c_custkey % 5 = 0 then 'failed' else 'scanned' end as status, case when c_custkey % 5 = 0 then 'e' || c_custkey else '' end as error from customer"


@query("store_roundtrip", f"""
with m as ({_saved_rows(DUCK)})
select digest, platform_architecture, status as last_scan_status, error as last_scan_error, 1::bigint as day_first, case when substr(digest, 8)::bigint % 3 = 0 then 2 else 1 end::bigint as day_last, 't' || (substr(digest, 8)::bigint % 20) as tag from m""")
def store_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Manifests and tags saved on two days, a third of them again on the second, read back from the store's current version."""
    st = store.Store(spark, f"{scratch(spark)}/store-{uuid.uuid4().hex}")
    m = i.rows(spark, d, _saved_rows)
    none = scan.detect_findings(spark.createDataFrame([], "source_type string, manifest_digest string, platform string, file_path string, layer_digest string, key string, present_in_final_image boolean, content binary"))
    number = F.substring("digest", 8, 20).cast("long")
    tags = m.select(F.concat(F.lit("t"), number % 20).alias("tag"), F.col("digest").alias("manifest_digest"), "root_digest", "platform_os", "platform_architecture", "platform_variant", "status", "error")
    st.save("docker.io", "library/img", m, tags, none, None, F.lit("2024-01-01").cast("timestamp"))
    st.save("docker.io", "library/img", m.where(number % 3 == 0), tags.limit(0), none, None, F.lit("2024-01-02").cast("timestamp"))
    t = st.tables()
    day = lambda c: F.dayofmonth(c).cast("long")
    got = t["manifests"].select("digest", "platform_architecture", "last_scan_status", "last_scan_error", day("first_seen_at").alias("day_first"), day("last_seen_at").alias("day_last"))
    return got.join(t["tags"].select(F.col("manifest_digest").alias("digest"), "tag"), "digest")
