"""Detection: content rows to matches.

A JVM-side gate keeps rows that some of the chosen rules could match; those go in Arrow batches through one function that runs
the rule table over bytes and settles which matches of a content stay. Line, snippets and line number are columns over the list of matches, which then is
exploded without the content. Nothing is shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar
from ..functions import secrets as s
from . import rules as r

MATCH = T.StructType(
    [
        T.StructField("detector_name", T.StringType(), False),
        T.StructField("value", T.BinaryType(), False),
        T.StructField("match_start", T.LongType(), False),
        T.StructField("match_end", T.LongType(), False),
        T.StructField("confidence", T.StringType(), False),
        T.StructField("priority", T.IntegerType(), False),
    ]
)
ALL = frozenset([*(x.name for x in r.RULES), "aws_shared_credentials", "git_credentials_password", "keyword_library", "keyword_entropy"])


class Match(NamedTuple):
    detector: str
    value: bytes
    start: int
    end: int
    confidence: str
    priority: int


class Line(NamedTuple):
    value: bytes
    at: int


def lines(content: bytes) -> list[Line]:
    """Lines end at newlines only; a carriage return stays in its line."""
    out, at = [], 0
    for part in content.split(b"\n"):
        out.append(Line(part, at))
        at += len(part) + 1
    return out


@lru_cache(maxsize=None)
def _compiled(rule: r.Rule) -> tuple:
    gate = lambda p: re.compile(p) if p else None
    return rule.compiled(), gate(rule.path), gate(rule.key), tuple(h.encode() for h in rule.hint.split("|") if h)


def by_pattern(rule: r.Rule, content: bytes, low: bytes, path: str, key: str) -> list[Match]:
    """Matches of a rule of the table over the whole content."""
    pattern, gate, _, hints = _compiled(rule)
    if gate is not None and not gate.search(path.strip().lower()):
        return []
    if hints and not any(h in low for h in hints):
        return []
    out = []
    for m in pattern.finditer(content):
        a, b = m.span(rule.group)
        if 0 <= a < b and (rule.check is None or rule.check(content[a:b])):
            out.append(Match(rule.name, content[a:b], a, b, s.confidence(rule.base, path, key, content[a:b]), rule.priority))
    return out


def by_key(rule: r.Rule, found: list[Line], path: str, key: str) -> list[Match]:
    """Values of a sensitive key: after an assignment, or alone in their line."""
    pattern, _, gate, _ = _compiled(rule)
    k = key.strip().lower()
    if not k or not gate.search(k):
        return []
    out = []
    for line in found:
        for m in pattern.finditer(line.value):
            a, b = m.span()
            if (s.assigned(line.value[:a]) or s.standalone(line.value, a, b)) and rule.check(m[0]):
                out.append(Match(rule.name, m[0], line.at + a, line.at + b, s.confidence(rule.base, path, key, m[0]), rule.priority))
    return out


_CANDIDATE = re.compile(r.CANDIDATE.encode())


def candidates(found: list[Line], key: str) -> list[tuple[Line, int, int, str]]:
    """Entropy candidates on keyword lines with what speaks against each ('' if nothing does)."""
    out = []
    for line in found:
        if line.value.strip() and (s.keyword_line(line.value) or s.sensitive_key(key)):
            for m in _CANDIDATE.finditer(line.value):
                why = "no_context" if not s.entropy_context(line.value, key, *m.span()) else s.no_secret_shape(m[0]) or ("" if s.entropy_ok(m[0]) else "low_entropy")
                out.append((line, *m.span(), why))
    return out


def by_entropy(found: list[Line], path: str, key: str) -> list[Match]:
    return [Match("keyword_entropy", x.value[a:b], x.at + a, x.at + b, s.confidence("low", path, key, x.value[a:b]), r.ENTROPY) for x, a, b, why in candidates(found, key) if not why]


_ENTRY = re.compile(rb"[ \t]*([^=:]*)[=:][ \t]*(.*?)[ \t]*\Z", re.S)
_AWS_KINDS = {"aws_access_key_id": ("access_key_id", s.aws_access_key), "aws_secret_access_key": ("secret_access_key", s.aws_secret), "aws_session_token": ("session_token", s.aws_session_token)}


def ini_entries(found: list[Line]) -> list[tuple[str, str, bytes, int, int]]:
    """(section, key, value, start, end) of each `key = value` or `key: value`; quotes around a value are not part of it."""
    out, section = [], "default"
    for line in found:
        t = line.value.strip()
        if not t or t[:1] in b"#;":
            continue
        if t[:1] == b"[" and t[-1:] == b"]":
            section = s.text(t[1:-1]).strip().lower().removeprefix("profile ") or "default"
            continue
        m = _ENTRY.match(line.value)
        if not m or not m[1].strip() or not m[2]:
            continue
        a, b = m.span(2)
        if b - a >= 2 and line.value[a : a + 1] in (b'"', b"'") and line.value[b - 1 : b] == line.value[a : a + 1]:
            a, b = a + 1, b - 1
        value = line.value[a:b].strip()
        if value and b > a:
            out.append((section, s.text(m[1]).strip().lower(), value, line.at + a, line.at + b))
    return out


def by_aws_file(found: list[Line], path: str) -> list[Match]:
    """Keys of an AWS credentials file. Key ids and session tokens are sure only where their profile holds a secret."""
    entries = [e for e in ini_entries(found) if e[1] in _AWS_KINDS]
    whole = {e[0] for e in entries if e[1] != "aws_access_key_id"}
    out = []
    for section, key, value, a, b in entries:
        kind, check = _AWS_KINDS[key]
        if check(value):
            sure = section in whole or key == "aws_secret_access_key"
            out.append(Match(f"aws_shared_credentials_{kind}", value, a, b, "high" if sure else "medium", r.STRUCTURED))
    return out


def by_git_file(found: list[Line]) -> list[Match]:
    out = []
    for line in found:
        t = line.value.strip()
        u = s.parse_url(s.text(t)) if t and s.basic_auth_url(t) else None
        if u:
            needle = f":{u.password}@".encode()
            at = line.value.find(needle)
            if at >= 0:
                value = needle[1:-1]
                out.append(Match("git_credentials_password", value, line.at + at + 1, line.at + at + 1 + len(value), "high", r.STRUCTURED))
    return out


@lru_cache(maxsize=None)
def _library(parts: tuple[r.Part, ...]) -> list[tuple[r.Part, tuple[bytes, ...], re.Pattern, re.Pattern | None]]:
    one, seen = [], set()
    for p in parts:
        if (p.kind, p.version) not in seen:
            seen.add((p.kind, p.version))
            one.append((p, tuple(k.lower().encode() for k in p.keywords), re.compile(p.raw.encode()), re.compile(p.second.encode()) if p.second else None))
    return one


@lru_cache(maxsize=None)
def _automaton(parts: tuple[r.Part, ...]):
    """Aho-Corasick automaton over the library's keywords, or None without the optional module."""
    try:
        import ahocorasick
    except ImportError:
        return None
    out = ahocorasick.Automaton()
    for _, keys, _, _ in _library(parts):
        for k in keys:
            out.add_word(k.decode(), k.decode())
    out.make_automaton()
    return out


class Places:
    """Where reported values stand: each value is sought behind its last place, then from the start."""

    def __init__(self, content: bytes) -> None:
        self.content, self.next = content, Counter()

    def find(self, values: list[bytes]) -> tuple[int, int] | None:
        for v in values:
            for begin in dict.fromkeys((self.next[v], 0)):
                at = self.content.find(v, begin)
                if at >= 0:
                    self.next[v] = at + len(v)
                    return at, at + len(v)
        return None


def _clean(value: bytes) -> bytes:
    v = value.strip()
    return v if v and s.printable(v) else b""


def search_values(raw: bytes, both: bytes) -> list[bytes]:
    """What to look for, in order: the reported values, then their fragments of eight bytes and more."""
    values = [_clean(raw), _clean(both)]
    for v in tuple(values):
        values += [f for f in (_clean(x) for x in re.split(rb"[:;,\s]", v)) if len(f) >= 8]
    return list(dict.fromkeys(v for v in values if v))


def by_library(content: bytes, low: bytes, path: str, key: str, parts: tuple[r.Part, ...] = r.LIBRARY_PARTS) -> list[Match]:
    """Detectors whose keyword occurs; a failing one gives no rows."""
    auto = _automaton(parts)
    words = {k for _, k in auto.iter(low.decode("latin-1"))} if auto is not None else None
    places, out = Places(content), []
    for part, keys, raw, second in _library(parts):
        if keys and not any((k.decode() in words) if words is not None else (k in low) for k in keys):
            continue
        try:
            found = [(m[0], m[0]) for m in raw.finditer(content)]
            if second is not None:
                found = [(a, a + b[0]) for a, _ in found for b in second.finditer(content)]
            if part.kind == "URI":
                found = [(re.sub(rb"(?<=[^:/])/.*", b"", a, flags=re.S), a) for a, _ in found if s.basic_auth_url(a)]
        except (re.error, ValueError, RecursionError):
            continue
        for a, b in found:
            at = places.find(search_values(a, b))
            if at:
                value = _clean(b) or _clean(a) or content[slice(*at)]
                out.append(Match(r.library_name(part.kind), value, *at, s.confidence("medium", path, key, value), r.LIBRARY))
    return out


def settle(found: list[Match]) -> list[Match]:
    """Without placeholders, in order; of matches with the same value and span the first by priority, confidence and name."""
    keep = [m for m in found if not s.discard_reason(m.value)]
    keep.sort(key=lambda m: (m.start, m.end, -m.priority, -r.RANK[m.confidence], m.value, m.detector))
    return list({(m.value, m.start, m.end): m for m in reversed(keep)}.values())[::-1]


def scan(content: bytes, path: str = "", key: str = "", only: frozenset[str] = ALL, rules: tuple[r.Rule, ...] = r.RULES, parts: tuple[r.Part, ...] = r.LIBRARY_PARTS) -> list[Match]:
    """All matches of one content."""
    low, found = content.lower(), None
    out: list[Match] = []
    place = path.strip().lower()
    for rule in rules:
        if rule.name in only:
            if rule.key is None:
                out += by_pattern(rule, content, low, path, key)
            elif key.strip():
                found = lines(content) if found is None else found
                out += by_key(rule, found, path, key)
    if "aws_shared_credentials" in only and re.search(r.AWS_FILE, place):
        out += by_aws_file(lines(content), path)
    if "git_credentials_password" in only and re.search(r.GIT_FILE, place):
        out += by_git_file(lines(content))
    if "keyword_library" in only:
        out += by_library(content, low, path, key, parts)
    if "keyword_entropy" in only and len(content) >= s.MIN_ENTROPY_BYTES:
        out += by_entropy(lines(content) if found is None else found, path, key)
    return settle(out)


def gate(content: Column, path: Column, key: Column, only: frozenset[str] = ALL, rules: tuple[r.Rule, ...] = r.RULES, parts: tuple[r.Part, ...] = r.LIBRARY_PARTS) -> Column:
    """Whether any of the chosen rules could match: evaluated before the Python function, in the JVM."""
    chosen = [x for x in rules if x.name in only]
    if any(not x.hint and not x.path and not x.key for x in chosen) or ("keyword_library" in only and any(not p.keywords for p in parts)):
        return F.lit(True)
    words = [re.escape(h) for x in chosen if not x.path for h in x.hint.split("|") if h]
    words += [re.escape(k) for p in parts for k in p.keywords] if "keyword_library" in only else []
    words += [s.KEYWORDS.decode()] if "keyword_entropy" in only else []
    paths = [x.path for x in chosen if x.path] + [p for p, name in ((r.AWS_FILE, "aws_shared_credentials"), (r.GIT_FILE, "git_credentials_password")) if name in only]
    out = content.cast("string").rlike("(?i)" + "|".join(dict.fromkeys(words))) if words else F.lit(False)
    if paths:
        out = out | F.lower(F.trim(path)).rlike("|".join(x.replace(r"\Z", "$") for x in dict.fromkeys(paths)))
    if "keyword_entropy" in only or any(x.key for x in chosen):
        k = F.lower(F.trim(key))
        for word in s.SENSITIVE_IN_KEY + ("client", "secret"):
            out = out | k.contains(word)
        for x in chosen:
            if x.key:
                out = out | k.rlike(x.key)
    return out


def _udf(only: frozenset[str], rules: tuple[r.Rule, ...], parts: tuple[r.Part, ...]):
    kind = pa.list_(pa.struct([("detector_name", pa.string()), ("value", pa.binary()), ("match_start", pa.int64()), ("match_end", pa.int64()), ("confidence", pa.string()), ("priority", pa.int32())]))

    @F.arrow_udf(T.ArrayType(MATCH, False))
    def run(content: pa.Array, path: pa.Array, key: pa.Array) -> pa.Array:
        rows = []
        for c, p, k in zip(content.to_pylist(), path.to_pylist(), key.to_pylist()):
            rows.append([{"detector_name": m.detector, "value": m.value, "match_start": m.start, "match_end": m.end, "confidence": m.confidence, "priority": m.priority} for m in scan(c or b"", p or "", k or "", only, rules, parts)])
        return pa.array(rows, kind)

    return run


def detect(content_rows: DataFrame, only=None, more: tuple[r.Rule, ...] = (), library: tuple[r.Part, ...] = ()) -> DataFrame:
    """content_rows (content binary or string, file_path, key and others) with a row per match, and instead of the content the match's line, snippets and line number.

    only: names of rules to run (None: all). more, library: a user's own rules and keyword detectors, run beside the built-in ones. A null content, path or key is as empty.
    """
    rules, parts = r.RULES + tuple(more), r.LIBRARY_PARTS + tuple(library)
    chosen = frozenset(ALL | {x.name for x in more} if only is None else only)
    names = {c: F.coalesce(F.col(c), F.lit("")) for c in ("file_path", "key")}
    rows = content_rows.withColumns(names).withColumn("content", F.col("content").cast("binary"))
    rows = rows.where(gate(F.col("content"), F.col("file_path"), F.col("key"), chosen, rules, parts))
    rows = rows.withColumn("found", _udf(chosen, rules, parts)(F.col("content"), F.col("file_path"), F.col("key"))).where("size(found) > 0")

    def placed(m: Column) -> Column:
        text, c, a, b = m["value"].cast("string"), F.col("content"), m["match_start"], m["match_end"]
        own = [m[f.name].alias(f.name) for f in MATCH]
        return F.struct(*own, scalar.match_line(c, a, b).alias("line"), scalar.snippet(c, scalar.redact(text), a, b).alias("context_snippet"), scalar.snippet(c, text, a, b).alias("raw_snippet"), scalar.line_number(c, a).alias("line_number"))

    rows = rows.withColumn("found", F.transform("found", placed)).drop("content")
    return rows.withColumn("m", F.explode("found")).select(*[c for c in rows.columns if c != "found"], "m.*")


def entropy_candidates(content_rows: DataFrame) -> DataFrame:
    """Every entropy candidate on a keyword line, with the verdict ('' accepted, else the reason against it)."""
    kind = pa.list_(pa.struct([("value", pa.binary()), ("match_start", pa.int64()), ("match_end", pa.int64()), ("verdict", pa.string())]))

    @F.arrow_udf("array<struct<value:binary,match_start:bigint,match_end:bigint,verdict:string>>")
    def run(content: pa.Array, key: pa.Array) -> pa.Array:
        return pa.array([[{"value": x.value[a:b], "match_start": x.at + a, "match_end": x.at + b, "verdict": why} for x, a, b, why in candidates(lines(c or b""), k or "")] for c, k in zip(content.to_pylist(), key.to_pylist())], kind)

    rows = content_rows.withColumn("content", F.col("content").cast("binary")).withColumn("key", F.coalesce("key", F.lit("")))
    rows = rows.where(F.col("content").cast("string").rlike("(?i)" + s.KEYWORDS.decode()) | (F.col("key") != ""))
    return rows.withColumn("m", F.explode(run(F.col("content"), F.col("key")))).select("*", "m.*").drop("m", "content")
