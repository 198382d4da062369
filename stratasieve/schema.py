"""Schemas of images, findings and the seven persistent tables. Absent text is the empty string."""

from __future__ import annotations

from pyspark.sql import types as T


_KINDS = {"bigint": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "boolean": T.BooleanType(), "binary": T.BinaryType(), "timestamp": T.TimestampType()}


def _struct(fields: str) -> T.StructType:
    """A flat schema from `name kind, name kind`, without a session."""
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (f.split() for f in fields.split(", "))])


PLATFORM = "struct<os:string,architecture:string,variant:string>"
DESCRIPTOR = f"struct<mediaType:string,artifactType:string,digest:string,size:bigint,urls:array<string>,annotations:map<string,string>,platform:{PLATFORM}>"
MANIFEST = f"struct<schemaVersion:int,mediaType:string,artifactType:string,config:{DESCRIPTOR},layers:array<{DESCRIPTOR}>,manifests:array<{DESCRIPTOR}>>"
PAYLOAD = "struct<Hostname:string,Domainname:string,User:string,WorkingDir:string,Env:array<string>,Cmd:array<string>,Entrypoint:array<string>,Shell:array<string>,OnBuild:array<string>,Labels:map<string,string>,ExposedPorts:map<string,string>,Volumes:map<string,string>>"
CONFIG = f"struct<architecture:string,os:string,variant:string,author:string,container:string,config:{PAYLOAD},container_config:{PAYLOAD},history:array<struct<created_by:string,comment:string,author:string>>>"
CONTENT_ROWS = _struct("content_id bigint, source_type string, manifest_digest string, platform string, file_path string, layer_digest string, key string, present_in_final_image boolean, content binary")
LAYER_ENTRIES = _struct("layer_digest string, entry_idx int, path string, kind string, linkname string, size bigint, content_class string, scannable boolean, content binary")
MANIFEST_LAYERS = _struct("manifest_digest string, layer_idx int, layer_digest string, media_type string")

_SEEN = "first_seen_at timestamp, last_seen_at timestamp"
_PLATFORM = "platform_os string, platform_architecture string, platform_variant string"
TABLES = {
    "repositories": _struct(f"id bigint, registry string, repository string, {_SEEN}"),
    "manifests": _struct(f"digest string, {_PLATFORM}, {_SEEN}, last_scan_status string, last_scan_error string"),
    "repository_manifests": _struct(f"repository_id bigint, manifest_digest string, root_digest string, {_SEEN}, last_scan_status string, last_scan_error string"),
    "tags": _struct(f"repository_id bigint, tag string, manifest_digest string, root_digest string, {_PLATFORM}, status string, error string, {_SEEN}"),
    "findings": _struct(f"id bigint, manifest_digest string, fingerprint string, redacted_value string, value string, {_SEEN}"),
    "finding_occurrences": _struct(
        f"id bigint, finding_id bigint, detector_name string, confidence string, source_type string, {_PLATFORM}, file_path string, layer_digest string, source_key string, context_snippet string, raw_snippet string, source_location string, match_start int, match_end int, present_in_final_image boolean, {_SEEN}, disposition string, disposition_reason string, line_number int"
    ),
    "scan_runs": _struct(
        "id bigint, repository_id bigint, requested_reference string, resolved_reference string, requested_digest string, mode string, status string, error_message string, tags_enumerated int, tags_resolved int, tags_failed int, target_count int, completed_target_count int, failed_target_count int, manifest_count int, completed_manifest_count int, failed_manifest_count int, total_findings int, unique_fingerprints int, suppressed_findings_count int, suppressed_unique_fingerprints int, result_json string, scanned_at timestamp"
    ),
}
#: natural keys that upserts match on
KEYS = {
    "repositories": ["registry", "repository"],
    "manifests": ["digest"],
    "repository_manifests": ["repository_id", "manifest_digest"],
    "tags": ["repository_id", "tag", "manifest_digest", "platform_os", "platform_architecture", "platform_variant"],
    "findings": ["manifest_digest", "fingerprint"],
    "finding_occurrences": ["finding_id", "detector_name", "confidence", "source_type", "platform_os", "platform_architecture", "platform_variant", "file_path", "layer_digest", "source_key", "context_snippet", "raw_snippet", "source_location", "match_start", "match_end", "present_in_final_image"],
}
