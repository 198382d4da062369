"""Example classification and confidence as Spark columns: no Python at run time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import secrets as s

# Word lists of the classification.
TEST_SEGMENTS = ("test", "tests", "__tests__", "fixture", "fixtures", "mock", "mocks")
EXAMPLE_SEGMENTS = ("example", "examples", "sample", "samples", "demo", "demos", "doc", "docs")
EXAMPLE_FILE = r"\.(example|sample|template)(\.|\z)"
MARKERS = ("placeholder", "dummy", "fake", "changeme", "change_me", "replace_me", "replace-me", "replace this", "your_token_here", "your-token-here", "your_secret_here", "your-secret-here", "example token", "sample token")
DUMMIES = ("changeme", "replace_me", "replace-me", "dummy", "fake", "your_token_here", "your_secret_here")
RESERVED_HOSTS = ("example.com", "example.org", "example.net", "localhost", "127.0.0.1", "0.0.0.0")
KEY_WORDS = ("example", "sample", "demo")


def any_of(value: Column, words) -> Column:
    """Whether the lower-cased value holds one of the words."""
    out, low = F.lit(False), F.lower(value)
    for w in words:
        out = out | low.contains(w)
    return out


def segments(path: Column) -> Column:
    """Lower-cased segments of a path; `..` takes its parent away, `.` and empty ones go."""
    parts = F.split(F.replace(F.trim(path), F.lit("\\"), F.lit("/")), "/")
    clean = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(x.isin("", "."), acc).when((x == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != ".."), F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(F.concat(acc, F.array(x))))
    return F.transform(clean, lambda x: F.lower(F.trim(x)))


def basename(path: Column) -> Column:
    return F.lower(F.trim(F.element_at(F.split(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/+$", ""), "/"), -1)))


def in_test_path(path: Column) -> Column:
    return F.arrays_overlap(segments(path), F.array(*map(F.lit, TEST_SEGMENTS)))


def example_filename(path: Column) -> Column:
    return basename(path).rlike(EXAMPLE_FILE)


def known_dummy(value: Column) -> Column:
    v = F.regexp_replace(F.trim(value), r"^[\"'`]+|[\"'`]+$", "")
    return F.upper(v).contains("EXAMPLE") | F.lower(v).isin(*DUMMIES)


def example_reason(path: Column, key: Column, line: Column, value: Column) -> Column:
    """The first reason that makes a match an example, or ''. Two of three weak signals make one."""
    weak_path = F.arrays_overlap(segments(path), F.array(*map(F.lit, EXAMPLE_SEGMENTS)))
    weak_host = any_of(line, RESERVED_HOSTS) | any_of(value, RESERVED_HOSTS)
    weak_key = any_of(key, KEY_WORDS)
    number = weak_path.cast("int") + weak_host.cast("int") + weak_key.cast("int")
    marker = F.lit(False)
    for x in (path, key, line, value):
        marker = marker | any_of(x, MARKERS)
    return (
        F.when(in_test_path(path), "test_path")
        .when(example_filename(path), "example_path")
        .when(known_dummy(value), "known_dummy_value")
        .when(marker, "placeholder_marker")
        .when((number >= 2) & weak_path, "example_path")
        .when((number >= 2) & weak_host, "reserved_host")
        .otherwise("")
    )


def confidence(base: Column, path: Column, key: Column, value: Column) -> Column:
    """Confidence after the sensitive traits of path, key and value."""
    p = F.lower(F.trim(path))
    traits = (basename(p).isin(*s.SENSITIVE_FILES) | any_of(p, s.SENSITIVE_IN_PATH)).cast("int") + any_of(key, s.SENSITIVE_IN_KEY).cast("int") + any_of(value, s.SENSITIVE_IN_VALUE).cast("int")
    return F.when((base == "low") & (traits >= 2), "high").when((base == "low") & (traits == 1), "medium").when((base == "medium") & (traits >= 1), "high").otherwise(base)
