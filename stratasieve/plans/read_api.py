"""Read queries over the state tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.references import normal_registry

PAGE, MOST = 50, 200


def page(df: DataFrame, limit: int | None = None, offset: int | None = None) -> DataFrame:
    """Rows of a page: limit 1 or more, at most 200, default 50; offset 0 or more."""
    limit, offset = PAGE if limit is None else limit, offset or 0
    if limit < 1 or offset < 0:
        raise ValueError("limit is 1 or more, offset 0 or more")
    return df.offset(offset).limit(min(limit, MOST))


def disposition(value: str | None, default: str = "actionable") -> str:
    v = (value or "").strip().lower() or default
    if v not in ("actionable", "suppressed", "all"):
        raise ValueError("a disposition is actionable, suppressed or all")
    return v


def _repository(repositories: DataFrame, registry: str, repository: str) -> DataFrame:
    return repositories.where((F.col("registry") == normal_registry(registry)) & (F.col("repository") == repository))


def list_repositories(t: dict[str, DataFrame], limit: int | None = None, offset: int | None = None) -> DataFrame:
    """Latest first."""
    r = t["repositories"].select("registry", "repository", "first_seen_at", "last_seen_at")
    return page(r.orderBy(F.desc("last_seen_at"), "repository", "registry"), limit, offset)


RUN = ["id", "registry", "repository", "requested_reference", "resolved_reference", "requested_digest", "mode", "status", "error_message", "tags_enumerated", "tags_resolved", "tags_failed", "target_count", "completed_target_count", "failed_target_count", "manifest_count", "completed_manifest_count", "failed_manifest_count", "total_findings", "unique_fingerprints", "suppressed_findings_count", "suppressed_unique_fingerprints", "scanned_at"]


def list_scans(t: dict[str, DataFrame], registry: str, repository: str, limit: int | None = None, offset: int | None = None) -> DataFrame:
    """Runs of a repository, latest first."""
    r = _repository(t["repositories"], registry, repository).select(F.col("id").alias("repository_id"), "registry", "repository")
    return page(t["scan_runs"].join(r, "repository_id").select(*RUN).orderBy(F.desc("scanned_at"), F.desc("id")), limit, offset)


def _summary(joined: DataFrame) -> DataFrame:
    count = lambda c: F.count(F.when(c, 1))
    kept = ["manifest_digest", "fingerprint", "redacted_value", "first_seen_at", "last_seen_at"]
    g = joined.groupBy("id").agg(
        *[F.any_value(c).alias(c) for c in kept],
        F.count("*").alias("occurrence_count"),
        count(F.col("disposition") == "actionable").alias("actionable_occurrence_count"),
        count(F.col("disposition") == "example").alias("suppressed_occurrence_count"),
        F.array_sort(F.collect_set("detector_name")).alias("detectors"),
    )
    return g.select("id", *kept, "occurrence_count", "actionable_occurrence_count", "suppressed_occurrence_count", "detectors")


def _occurrences(t: dict[str, DataFrame]) -> DataFrame:
    return t["finding_occurrences"].select(F.col("finding_id").alias("id"), "disposition", "detector_name")


def list_findings(t: dict[str, DataFrame], registry: str, repository: str, which: str | None = None, limit: int | None = None, offset: int | None = None) -> DataFrame:
    """Findings of a repository with their counts (which stay unfiltered), latest first. which: actionable, suppressed or all."""
    r = _repository(t["repositories"], registry, repository).select(F.col("id").alias("repository_id"))
    m = t["repository_manifests"].join(r, "repository_id").select("manifest_digest")
    f = t["findings"].drop("value").join(m, "manifest_digest")
    out = _summary(f.join(_occurrences(t), "id"))
    which = disposition(which)
    if which != "all":
        out = out.where(F.col(f"{which}_occurrence_count") > 0)
    return page(out.orderBy(F.desc("last_seen_at"), F.desc("id")), limit, offset)


def get_scan(t: dict[str, DataFrame], id_: int) -> DataFrame:
    """One run with its snapshot; no row if there is none."""
    r = t["repositories"].select(F.col("id").alias("repository_id"), "registry", "repository")
    return t["scan_runs"].where(F.col("id") == id_).join(r, "repository_id").select(*RUN, "result_json")


OCCURRENCE = ["detector_name", "confidence", "disposition", "disposition_reason", "source_type", "platform_os", "platform_architecture", "platform_variant", "file_path", "layer_digest", "source_key", "line_number", "context_snippet", "source_location", "match_start", "match_end", "present_in_final_image", "first_seen_at", "last_seen_at"]


def get_finding(t: dict[str, DataFrame], id_: int) -> tuple[DataFrame, DataFrame]:
    """Summary of one finding, and its occurrences, latest first. Raw values are in neither."""
    f = t["findings"].drop("value").where(F.col("id") == id_)
    occ = t["finding_occurrences"].where(F.col("finding_id") == id_)
    return _summary(f.join(_occurrences(t).where(F.col("id") == id_), "id")), occ.orderBy(F.desc("last_seen_at"), "source_location", "id").select(*OCCURRENCE)


