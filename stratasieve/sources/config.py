"""Settings with defaults and validation, from a mapping such as the environment or Spark's configuration."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields

MIB = 1 << 20


@dataclass(frozen=True)
class Settings:
    """Limits of 0 are off where `positive` below doesn't name them."""

    findings_dir: str = "findings"
    tag_page_size: int = 100
    http_timeout_s: int = 30
    http_attempts: int = 2
    max_file_bytes: int = MIB
    max_layer_bytes: int = 512 * MIB
    max_layer_entries: int = 50_000
    max_manifest_bytes: int = 0
    max_config_bytes: int = 0
    max_tag_response_bytes: int = 8 * MIB
    max_repository_tags: int = 0
    max_repository_targets: int = 0
    registry_base_url: str = ""
    registry_auth_url: str = ""
    log_level: str = "info"
    api_addr: str = "127.0.0.1:8080"
    persist_raw: bool = False
    state_dir: str = ""


POSITIVE = ("tag_page_size", "http_timeout_s", "http_attempts", "max_file_bytes")


def load(values: Mapping[str, str], prefix: str = "STRATASIEVE_") -> Settings:
    """Settings from values named prefix + upper-case field. A blank value is the default; a bad one is an error that names it."""
    found: dict = {}
    for f in fields(Settings):
        raw = values.get(prefix + f.name.upper(), "").strip()
        if not raw:
            continue
        if f.type == "int":
            try:
                found[f.name] = int(raw)
            except ValueError:
                raise ValueError(f"{prefix}{f.name.upper()} is no whole number") from None
            least = 1 if f.name in POSITIVE else 0
            if found[f.name] < least:
                raise ValueError(f"{prefix}{f.name.upper()} is less than {least}")
        elif f.type == "bool":
            if raw.lower() not in ("1", "0", "true", "false"):
                raise ValueError(f"{prefix}{f.name.upper()} is neither true nor false")
            found[f.name] = raw.lower() in ("1", "true")
        else:
            found[f.name] = raw
    return Settings(**found)
