"""Scalar functions on values, snippets and places, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS = 24


def blank(value: Column) -> Column:
    return F.coalesce(F.trim(value), F.lit("")) == ""


def first_non_blank(*values: Column) -> Column:
    """The first value that is more than white space, as it is; else ''."""
    out = F.lit("")
    for v in reversed(values):
        out = F.when(~blank(v), v).otherwise(out)
    return out


def redact(value: Column) -> Column:
    """Up to six characters: stars; several lines: the first line and a mark; else three, stars, two."""
    n = F.char_length(value)
    return (
        F.when(value == "", "")
        .when(value.contains("\n"), F.concat(F.substring_index(value, "\n", 1), F.lit("...redacted...")))
        .when(n <= 6, F.repeat(F.lit("*"), n))
        .otherwise(F.concat(F.left(value, F.lit(3)), F.repeat(F.lit("*"), n - 5), F.right(value, F.lit(2))))
    )


def fingerprint(value: Column) -> Column:
    """Lower-case hex SHA-256 of the value's bytes."""
    return F.sha2(value.cast("binary"), 256)


def line_number(content: Column, at: Column) -> Column:
    """1 and the newlines before a byte offset. content: binary."""
    head = _text(content, F.lit(0), at)
    return F.lit(1) + F.octet_length(head) - F.octet_length(F.replace(head, F.lit("\n"), F.lit("")))


def _text(content: Column, a: Column, b: Column) -> Column:
    """Bytes a to b as a string, unchanged (it may hold cut characters)."""
    return F.substring(content, (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int")).cast("string")


def snippet(content: Column, value: Column, start: Column, end: Column) -> Column:
    """`value` between up to 24 bytes on each side, each side trimmed; the value alone where the span is not in the content."""
    n = F.octet_length(content)
    before = F.trim(F.regexp_replace(_text(content, F.greatest(start - RADIUS, F.lit(0)), start), r"^[\s]+|[\s]+$", ""))
    after = F.trim(F.regexp_replace(_text(content, end, F.least(end + RADIUS, n)), r"^[\s]+|[\s]+$", ""))
    ok = (n > 0) & (start >= 0) & (end <= n) & (start < end)
    return F.when(ok, F.concat_ws(" ", F.when(before != "", before), value, F.when(after != "", after))).otherwise(value)


def match_line(content: Column, start: Column, end: Column) -> Column:
    """The whole line, or lines, that a span lies in."""
    head = F.substring_index(_text(content, F.lit(0), start), "\n", -1)
    tail = F.substring_index(_text(content, end, F.octet_length(content)), "\n", 1)
    return F.concat(head, _text(content, start, end), tail)


def source_location(source_type: Column, path: Column, key: Column) -> Column:
    """`type:` and the path, else the key, else the type."""
    return F.concat(source_type, F.lit(":"), first_non_blank(path, key, source_type))


def platform_name(os: Column, architecture: Column, variant: Column) -> Column:
    """os/architecture[/variant] in lower case; '' without os and architecture."""
    o, a, v = (F.lower(F.trim(F.coalesce(x, F.lit("")))) for x in (os, architecture, variant))
    return F.when((o == "") & (a == ""), "").otherwise(F.concat_ws("/", o, a, F.when(v != "", v)))


def entropy(value: Column) -> Column:
    """Shannon entropy of the characters, in bits; 0 for ''."""
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    n = F.size(chars)
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))


def path_token(value: Column) -> Column:
    """A reference as part of a file name: runs of other than letters, digits, dot, hyphen and underscore become one hyphen."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(value)), r"[^a-z0-9._-]+", "-"), r"^[-.]+|[-.]+$", "")


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
