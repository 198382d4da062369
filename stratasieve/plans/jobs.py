"""Scans of a reference or of a whole repository, from the registry to saved state.

Tags, documents and layers are asked for on the executors; what was fetched is written under a folder before it is used twice. An error of one tag, target or manifest is
a row; a limit ends the run and keeps what came before it.
"""

from __future__ import annotations

import itertools
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import references as ref
from ..operators import findings as fnd
from ..operators import state
from ..sources import registry as reg
from ..sources.config import Settings
from ..sources.store import NoStore, Store
from . import scan as plan

_TAGS = "tag string, digest string, media_type string, error string"
_NO_TAGS = "tag string, error string"


@dataclass
class Run:
    """One job: what was asked for, what was found, and how it ended. error is empty after a complete run; limit says that a limit ended it."""

    reference: ref.Reference
    mode: str
    resolved_reference: str
    requested_digest: str
    scan: plan.Scan
    counts: dict[str, int]
    error: str = ""
    limit: bool = False

    @property
    def status(self) -> str:
        return self.scan.status(self.counts, self.error, self.limit)

    def exit_code(self) -> int:
        return 1 if self.error else 2 if self.counts["total_findings"] else 0

    def result(self) -> dict:
        """The public result without its findings, which can be many."""
        return {"requested_reference": self.reference.original, "repository": self.reference.repository, "mode": self.mode, "resolved_reference": self.resolved_reference, "requested_digest": self.requested_digest, "status": self.status, **self.counts, "error": self.error}

    def record(self, at) -> DataFrame:  # noqa: ANN001  a Column
        """The row of scan_runs, without id and repository_id."""
        spark = self.scan.findings.sparkSession
        text = {"requested_reference": self.reference.original, "resolved_reference": self.resolved_reference, "requested_digest": self.requested_digest, "mode": self.mode, "status": self.status, "error_message": self.error, "result_json": json.dumps(self.result())}
        return spark.range(1).select(*[F.lit(v).alias(k) for k, v in text.items()], *[F.lit(v).cast("int").alias(k) for k, v in self.counts.items()], at.alias("scanned_at"))

    def save(self, store: Store | NoStore, at, raw: bool = False) -> int | None:  # noqa: ANN001
        return store.save(self.reference.registry, self.reference.repository, self.scan.manifests, self.scan.tags, self.scan.findings, self.record(at), at, raw)


def resolve_tags(spark: SparkSession, reference: ref.Reference, settings: Settings) -> DataFrame:
    """tag, digest, media_type and error of a repository's tags; a row without a tag is the error of the listing."""
    found = reg.tags(spark, [f"{reference.registry}/{reference.repository}"], settings)
    empty = (F.col("error") == "") & (F.col("tag") != "") & (F.trim("digest") == "")
    return found.select("tag", F.trim("digest").alias("digest"), "media_type", F.when(empty, "the tag names no digest").otherwise(F.col("error")).alias("error"))


def tag_counts(tags: DataFrame) -> DataFrame:
    """One row: tags_enumerated, tags_resolved and tags_failed."""
    named, good = F.col("tag") != "", F.col("error") == ""
    count = lambda c: F.count(F.when(c, 1))
    return tags.agg(count(named).alias("tags_enumerated"), count(named & good).alias("tags_resolved"), count(named & ~good).alias("tags_failed"))


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def run_scan(spark: SparkSession, reference: str, folder: str, settings: Settings = Settings(), platform: str = "", more: tuple = (), library: tuple = ()) -> Run:
    """Scan a reference, or every tag of a repository if it names neither tag nor digest. folder: where fetched and found rows are written."""
    r = ref.parse(reference)
    selector = ref.parse_platform(platform)
    error, limit = "", False
    if r.repository_only:
        mode, resolved, digest = "repository", f"{r.registry}/{r.repository}", ""
        tags = _written(resolve_tags(spark, r, settings), f"{folder}/tags")
        listing = tags.where("tag = '' and error <> ''").select("error").first()
        error, limit = (listing["error"], listing["error"].startswith("limit")) if listing else ("", False)
        roots = tags.where("tag <> '' and error = ''").select("tag", "digest")
    else:
        mode = "reference"
        tags = spark.createDataFrame([(r.tag or "latest", "", "", "")] if not r.digest else [], _TAGS)
        roots = spark.createDataFrame([(r.tag if not r.digest else "", r.identifier)], "tag string, digest string")
    failed = tags.where("tag <> '' and error <> ''").select("tag", "error")
    n = roots.select("digest").distinct().count()
    if not error and not n:
        error = f"no tag of {resolved} could be resolved"
    if not error and mode == "repository" and settings.max_repository_targets and n > settings.max_repository_targets:
        error, limit = f"limit: {n} targets, {settings.max_repository_targets} are allowed", True
    if error:
        roots = roots.limit(0)
    asked = itertools.count()

    def fetch(w: DataFrame) -> DataFrame:
        return _written(reg.fetch(w, r.registry, r.repository, settings), f"{folder}/documents-{next(asked)}")

    got = fetch(roots.select("digest", F.lit("manifest").alias("what")).distinct())
    bodies = got.select(F.col("asked"), F.col("digest").alias("root"), "body", F.col("media_type").alias("header_type"), "error")
    with_body = roots.withColumnRenamed("digest", "asked").join(bodies, "asked").select("tag", F.col("root").alias("digest"), "body", "header_type", "error")
    if mode == "reference":
        one = with_body.select("digest", "error").first()
        digest, resolved = (one["digest"], r.with_digest(one["digest"]).canonical) if one["error"] == "" else ("", r.canonical)
    layers = lambda kinds: _written(reg.decode_layers(kinds, r.registry, r.repository, settings), f"{folder}/layers")
    found = plan.scan_images(with_body, fetch, layers, selector, settings, failed, more, library, lambda df, name: _written(df, f"{folder}/{name}")).saved(f"{folder}/scan")
    counts = found.counts() | ({"target_count": n} if limit else {})
    counts |= tag_counts(tags).first().asDict() if mode == "repository" else {"tags_enumerated": int(not r.digest), "tags_resolved": int(not r.digest and digest != ""), "tags_failed": int(not r.digest and digest == "")}
    if not error:
        stopped = found.targets.where(F.col("error").startswith("limit")).select("error").first()
        if stopped:
            error, limit = stopped["error"], True
        elif not counts["completed_target_count"]:
            why = fnd.first_messages(found.targets.withColumn("all", F.lit(1)), ["all"], F.col("error"), F.struct("first_tag", "root_digest", "position")).first()
            error = "all targets failed" + (f": {why['messages']}" if why else "")
    return Run(r, mode, resolved, digest, found, counts, error, limit)


def scan_and_save(spark: SparkSession, reference: str, store: Store | NoStore, folder: str, at, settings: Settings = Settings(), platform: str = "", more: tuple = (), library: tuple = ()) -> Run:  # noqa: ANN001
    """A scan, saved whether it ended well or not."""
    run = run_scan(spark, reference, folder, settings, platform, more, library)
    run.save(store, at, settings.persist_raw)
    return run
