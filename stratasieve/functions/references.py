"""Image references, registries and platform selectors: Python for single values, columns for many."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

HUB = "docker.io"
# Names that mean the default registry.
HUB_ALIASES = ("docker.io", "index.docker.io", "registry-1.docker.io")


class ReferenceError_(ValueError):
    """A reference that can't be parsed."""


@dataclass(frozen=True)
class Reference:
    original: str
    registry: str
    repository: str
    tag: str = ""
    digest: str = ""
    tag_explicit: bool = False

    @property
    def identifier(self) -> str:
        return self.digest or self.tag or "latest"

    @property
    def repository_only(self) -> bool:
        return not self.digest and not self.tag_explicit

    @property
    def canonical(self) -> str:
        return f"{self.registry}/{self.repository}" + (f"@{self.digest}" if self.digest else f":{self.tag or 'latest'}")

    def with_tag(self, tag: str) -> "Reference":
        return replace(self, tag=tag, digest="", tag_explicit=True)

    def with_digest(self, digest: str) -> "Reference":
        return replace(self, digest=digest)


def normal_registry(value: str) -> str:
    v = value.strip().lower()
    return HUB if not v or v in HUB_ALIASES else v


def parse(raw: str) -> Reference:
    value = raw.strip()
    if not value or "://" in value:
        raise ReferenceError_("a reference is required" if not value else "a reference has no scheme")
    name, at, digest = value.rpartition("@") if "@" in value else (value, "", "")
    if at and ":" not in digest:
        raise ReferenceError_("a digest has an algorithm prefix")
    path, colon, tag = name.rpartition(":") if name.rfind(":") > name.rfind("/") else (name, "", "")
    if colon and not tag:
        raise ReferenceError_("a tag is required after the colon")
    head, _, rest = path.partition("/")
    registry, repository = (normal_registry(head), rest) if re.search(r"[.:]", head) or head == "localhost" else (HUB, path)
    if registry == HUB and repository and "/" not in repository:
        repository = f"library/{repository}"
    if not repository or repository[0] == "/" or repository[-1] == "/":
        raise ReferenceError_("a repository is required")
    return Reference(value, registry, repository, tag, digest, bool(colon))


def columns(raw: Column) -> dict[str, Column]:
    """registry, repository, tag, digest, identifier and canonical of a column of references; all null where it can't be parsed."""
    v = F.trim(raw)
    digest = F.when(v.contains("@"), F.substring_index(v, "@", -1)).otherwise("")
    name = F.when(v.contains("@"), F.regexp_extract(v, r"^(.*)@[^@]*$", 1)).otherwise(v)
    has_tag = name.rlike(r":[^/]*$")
    tag = F.when(has_tag, F.regexp_extract(name, r":([^:/]*)$", 1)).otherwise("")
    path = F.when(has_tag, F.regexp_extract(name, r"^(.*):[^:/]*$", 1)).otherwise(name)
    head = F.substring_index(path, "/", 1)
    own = head.rlike(r"[.:]") | (head == "localhost")
    low = F.lower(F.trim(head))
    registry = F.when(own & ~low.isin(*HUB_ALIASES), low).otherwise(HUB)
    rest = F.when(own, F.when(path.contains("/"), F.regexp_extract(path, r"^[^/]*/(.*)$", 1)).otherwise("")).otherwise(path)
    repository = F.when((registry == HUB) & (rest != "") & ~rest.contains("/"), F.concat(F.lit("library/"), rest)).otherwise(rest)
    good = (v != "") & ~v.contains("://") & (~v.contains("@") | digest.contains(":")) & ~(has_tag & (tag == "")) & (repository != "") & ~repository.startswith("/") & ~repository.endswith("/")
    identifier = F.when(digest != "", digest).when(tag != "", tag).otherwise("latest")
    canonical = F.concat(registry, F.lit("/"), repository, F.when(digest != "", F.concat(F.lit("@"), digest)).otherwise(F.concat(F.lit(":"), identifier)))
    found = {"registry": registry, "repository": repository, "tag": tag, "digest": digest, "identifier": identifier, "canonical": canonical}
    return {k: F.when(good, c) for k, c in found.items()}


def base_url(registry: Column) -> Column:
    """Where a registry is reached."""
    host = F.when(registry == HUB, "registry-1.docker.io").otherwise(registry)
    return F.concat(F.when(host.rlike(r"^(localhost|127\.0\.0\.1)(:|$)"), "http://").otherwise("https://"), host)


def parse_platform(selector: str) -> tuple[str, str, str] | None:
    """os/architecture[/variant], or None for a blank selector."""
    parts = [p.strip().lower() for p in selector.strip().split("/")]
    if parts == [""]:
        return None
    if len(parts) not in (2, 3) or not all(parts):
        raise ValueError("a platform is os/architecture or os/architecture/variant")
    return parts[0], parts[1], parts[2] if len(parts) == 3 else ""
