"""Registry access over HTTP: tags, manifests and blobs, and the same as a Spark data source.

One client per task; requests are idempotent, so a task may run again. Nothing is asked of a registry while a plan is built.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import schema
from ..functions.references import HUB
from ..operators import metadata
from ..operators.metadata import ACCEPTED
from . import layers as lay
from .config import Settings


class LimitError(Exception):
    """More than a limit allows; `partial` is what came before."""

    def __init__(self, what: str, partial: object = None) -> None:
        super().__init__(what)
        self.partial = partial


@dataclass
class Response:
    status: int
    headers: dict[str, str]
    body: bytes
    stream: BinaryIO | None = None


#: asks for a response that is read as a stream
STREAM = -1


def http(method: str, url: str, headers: dict[str, str], timeout: float, most: int = 0) -> Response:
    """One request. An HTTP error is a response, not an exception. Reads at most `most` + 1 bytes (0: all)."""
    request = urllib.request.Request(url, method=method, headers=headers)
    try:
        if most == STREAM:
            r = urllib.request.urlopen(request, timeout=timeout)
            return Response(r.status, {k.lower(): v for k, v in r.headers.items()}, b"", r)
        with urllib.request.urlopen(request, timeout=timeout) as r:
            return Response(r.status, {k.lower(): v for k, v in r.headers.items()}, r.read(most + 1) if most else r.read())
    except urllib.error.HTTPError as e:
        return Response(e.code, {k.lower(): v for k, v in e.headers.items()}, e.read())


def challenge(header: str) -> dict[str, str] | None:
    """Parameters of a bearer challenge."""
    kind, _, rest = header.strip().partition(" ")
    return dict(re.findall(r'(\w+)="([^"]*)"', rest)) if kind.lower() == "bearer" else None


def next_link(header: str, base: str) -> str | None:
    """Target of the link with rel=next."""
    for target, params in re.findall(r"<([^>]*)>([^,]*)", header):
        if re.search(r'rel\s*=\s*"?next"?\s*(;|$)', params.strip()):
            return urllib.parse.urljoin(base, target)
    return None


@dataclass
class Client:
    """Access to one registry."""

    registry: str
    settings: Settings = Settings()
    send: Callable[..., Response] = http
    tokens: dict[tuple[str, str, str], str] = field(default_factory=dict)

    @property
    def base(self) -> str:
        if self.settings.registry_base_url:
            return self.settings.registry_base_url.rstrip("/")
        host = "registry-1.docker.io" if self.registry == HUB else self.registry
        return ("http://" if re.match(r"(localhost|127\.0\.0\.1)(:|$)", host) else "https://") + host

    def _try(self, method: str, url: str, headers: dict[str, str], most: int) -> Response:
        """Again after a timeout, 408, 429 or 5xx, without a pause."""
        for left in range(self.settings.http_attempts - 1, -1, -1):
            try:
                r = self.send(method, url, headers, self.settings.http_timeout_s, most)
            except (TimeoutError, urllib.error.URLError):
                if not left:
                    raise
                continue
            if not left or not (r.status in (408, 429) or r.status >= 500):
                return r
        raise AssertionError("unreachable")

    def _token(self, c: dict[str, str], fresh: bool) -> str:
        key = (c.get("realm", ""), c.get("service", ""), c.get("scope", ""))
        if fresh or key not in self.tokens:
            query = urllib.parse.urlencode({k: v for k, v in (("service", key[1]), ("scope", key[2])) if v})
            r = self._try("GET", key[0] + ("?" + query if query else ""), {}, 0)
            if r.status != 200:
                raise OSError(f"no token: status {r.status}")
            got = json.loads(r.body)
            self.tokens[key] = got.get("token") or got.get("access_token") or ""
        return self.tokens[key]

    def ask(self, method: str, url: str, accept: str = "", most: int = 0) -> Response:
        """A request that answers a bearer challenge, and refreshes a token that is refused, once."""
        headers = {"Accept": accept} if accept else {}
        r = self._try(method, url, headers, most)
        for fresh in (False, True):
            c = challenge(r.headers.get("www-authenticate", "")) if r.status == 401 else None
            if c is None:
                break
            r = self._try(method, url, headers | {"Authorization": f"Bearer {self._token(c, fresh)}"}, most)
        return r

    def _get(self, method: str, url: str, what: str, accept: str = "", most: int = 0) -> Response:
        r = self.ask(method, url, accept, most)
        if r.status != 200:
            raise OSError(f"{what}: status {r.status}")
        if most > 0 and len(r.body) > most:
            raise LimitError(what)
        return r

    def list_tags(self, repository: str) -> list[str]:
        """All tags: trimmed, without blanks, each once, sorted. A LimitError carries those that were read."""
        url: str | None = f"{self.base}/v2/{repository}/tags/list?n={self.settings.tag_page_size}"
        tags: dict[str, None] = {}
        while url:
            r = self._get("GET", url, "tags", most=self.settings.max_tag_response_bytes)
            for t in json.loads(r.body).get("tags") or []:
                if t.strip():
                    tags[t.strip()] = None
                if self.settings.max_repository_tags and len(tags) > self.settings.max_repository_tags:
                    raise LimitError("tags", sorted(list(tags)[: self.settings.max_repository_tags]))
            url = next_link(r.headers.get("link", ""), url)
        return sorted(tags)

    def manifest(self, repository: str, identifier: str) -> tuple[str, str, bytes]:
        """Digest, media type and body."""
        r = self._get("GET", f"{self.base}/v2/{repository}/manifests/{identifier}", "manifest", ", ".join(ACCEPTED), self.settings.max_manifest_bytes)
        return r.headers.get("docker-content-digest", ""), r.headers.get("content-type", ""), r.body

    def resolve(self, repository: str, identifier: str) -> tuple[str, str]:
        """Digest and media type, by HEAD; by GET where that fails or names no digest."""
        try:
            r = self.ask("HEAD", f"{self.base}/v2/{repository}/manifests/{identifier}", ", ".join(ACCEPTED))
            if r.status == 200 and r.headers.get("docker-content-digest"):
                return r.headers["docker-content-digest"], r.headers.get("content-type", "")
        except OSError:
            pass
        return self.manifest(repository, identifier)[:2]

    def open_blob(self, repository: str, digest: str) -> BinaryIO:
        """A blob as a stream."""
        r = self._get("GET", f"{self.base}/v2/{repository}/blobs/{digest}", "blob", most=STREAM)
        return r.stream if r.stream is not None else io.BytesIO(r.body)

    def blob(self, repository: str, digest: str, most: int = 0) -> bytes:
        return self._get("GET", f"{self.base}/v2/{repository}/blobs/{digest}", "blob", most=most).body


class TagsReader(DataSourceReader):
    """One partition a repository: its tags with their digests; a tag that can't be resolved has an error."""

    def __init__(self, options: dict) -> None:
        self.repositories = [x.strip() for x in options.get("repositories", "").split(",") if x.strip()]
        self.settings = Settings(**json.loads(options.get("settings", "{}")))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(r) for r in self.repositories]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        registry, _, repository = partition.value.partition("/")
        client = Client(registry, self.settings)
        try:
            tags, failed = client.list_tags(repository), ""
        except LimitError as e:
            tags, failed = e.partial or [], f"limit: {e}"
        except OSError as e:
            tags, failed = [], str(e)
        for tag in tags:
            try:
                yield (registry, repository, tag, *client.resolve(repository, tag), "")
            except (OSError, LimitError) as e:
                yield registry, repository, tag, "", "", str(e)
        if failed:
            yield registry, repository, "", "", "", failed


class TagsSource(DataSource):
    """spark.read.format("registry_tags").option("repositories", "host/name,...")."""

    @classmethod
    def name(cls) -> str:
        return "registry_tags"

    def schema(self) -> str:
        return "registry string, repository string, tag string, digest string, media_type string, error string"

    def reader(self, schema) -> TagsReader:  # noqa: ANN001
        return TagsReader(dict(self.options))


def tags(spark: SparkSession, repositories: list[str], settings: Settings = Settings()) -> DataFrame:
    """registry, repository, tag, digest, media_type and error of all tags of repositories (host/name)."""
    spark.dataSource.register(TagsSource)
    return spark.read.format(TagsSource.name()).option("repositories", ",".join(repositories)).option("settings", json.dumps(asdict(settings))).load()


#: requests of one kind go to this many tasks at most
REQUESTS = 16


def fetch(wanted: DataFrame, registry: str, repository: str, settings: Settings = Settings()) -> DataFrame:
    """digest and what (manifest or blob) of small documents to digest, media_type, body (string) and error: one request per row, on the executors. A manifest may be named by a tag; `digest` then is its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = Client(registry, settings)
        for b in batches:
            rows = []
            for asked, what in zip(b["digest"].to_pylist(), b["what"].to_pylist()):
                digest, kind, body, error = asked, "", None, ""
                try:
                    if what == "manifest":
                        named, kind, body = client.manifest(repository, asked)
                        digest = asked if ":" in asked else named or "sha256:" + hashlib.sha256(body).hexdigest()
                    else:
                        body = client.blob(repository, asked, settings.max_config_bytes)
                except LimitError as e:
                    error = f"limit: {e}"
                except (OSError, ValueError) as e:
                    error = str(e) or type(e).__name__
                rows.append({"asked": asked, "digest": digest, "media_type": kind, "body": None if body is None else body.decode("utf-8", "replace"), "error": error})
            yield pa.RecordBatch.from_pylist(rows, schema=_FETCHED)

    one = wanted.select("digest", "what").distinct().repartition(REQUESTS, "digest")
    return one.mapInArrow(run, "asked string, digest string, media_type string, body string, error string")


_FETCHED = pa.schema([(c, pa.string()) for c in ("asked", "digest", "media_type", "body", "error")])


def decode_layers(layers: DataFrame, registry: str, repository: str, settings: Settings = Settings()) -> DataFrame:
    """layer_digest and media_type to schema.LAYER_ENTRIES: each blob is read as a stream where it is decoded, and never held whole."""
    one = layers.select("layer_digest", metadata.compression(metadata.media_type(F.col("media_type"))).alias("c")).repartition(REQUESTS, "layer_digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = Client(registry, settings)
        for b in batches:
            for digest, kind in zip(b["layer_digest"].to_pylist(), b["c"].to_pylist()):
                try:
                    with client.open_blob(repository, digest) as stream:
                        yield from lay.batches_of(digest, lay.entries(stream, kind, settings))
                except OSError as e:
                    yield from lay.batches_of(digest, iter([lay.failure(str(e))]))

    return one.mapInArrow(run, schema.LAYER_ENTRIES)
