"""Saving state: tables in buckets under one folder, and versions that say which files are current.

A version is one small file, named after its number, that lists the folder of each bucket of each table. A save reads and writes only
the buckets that its keys fall in, then creates the next version's file, which fails if another writer has made it: readers see all of a
save or none, at every moment. A version file that was cut off by a crash does not parse and is passed over.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import scalar
from ..operators import findings as fnd
from ..operators import state

BUCKETS = 64
#: what a row's bucket is taken from
SPREAD = {"repositories": "repository", "manifests": "digest", "repository_manifests": "repository_id", "tags": "repository_id", "findings": "manifest_digest", "finding_occurrences": "finding_id", "scan_runs": "repository_id"}


class Conflict(Exception):
    """Another writer has saved since this one read."""


class InvalidRecord(ValueError):
    """A row that may not be saved."""


class NoStore:
    """Saves nothing."""

    def save(self, *_: object) -> None:
        return None


def bucket(table: str) -> Column:
    return F.pmod(F.xxhash64(SPREAD[table]), F.lit(BUCKETS)).cast("int")


class Store:
    """The seven tables."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _read(self, name: str) -> str:
        return "\n".join(r[0] for r in self.spark.read.option("wholetext", True).text(f"{self.root}/{name}").collect())  # one small file

    def _create(self, name: str, body: str) -> bool:
        """Write a new file; False if it is there already."""
        fs, path = self._fs(), self._path(name)
        if fs.exists(path):
            return False
        try:
            out = fs.create(path, False)
        except Exception:  # noqa: BLE001  the JVM's exception for a file that exists differs between file systems
            if fs.exists(path):
                return False
            raise
        out.write(bytearray(body.encode()))
        out.close()
        return True

    def _versions(self) -> list[int]:
        fs, folder = self._fs(), self._path("versions")
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(folder) if f.getPath().getName().isdigit()) if fs.exists(folder) else []

    def current(self) -> tuple[int, dict[str, dict[str, str]]]:
        """The last whole version: its number (0: none) and the folder of each bucket by table."""
        for n in reversed(self._versions()):
            try:
                return n, json.loads(self._read(f"versions/{n:012d}"))
            except ValueError:
                continue
        return 0, {}

    def table(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        return self._table(self.current()[1], name, buckets)

    def _table(self, version: dict[str, dict[str, str]], name: str, buckets: list[int] | None = None) -> DataFrame:
        kind, at = schema.TABLES[name], version.get(name, {})
        paths = [f"{self.root}/{folder}" for b, folder in at.items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(kind).parquet(*paths) if paths else self.spark.createDataFrame([], kind)

    def tables(self) -> dict[str, DataFrame]:
        version = self.current()[1]
        return {t: self._table(version, t) for t in schema.TABLES}

    def update(self, incoming: dict[str, DataFrame], apply: dict) -> int:
        """apply[table](rows of the buckets that incoming[table] falls in) replaces those buckets. Returns the new version's number."""
        number, version = self.current()
        latest = max([number, *self._versions()])
        new, name = {t: dict(version.get(t, {})) for t in schema.TABLES}, uuid.uuid4().hex
        for t, rows in incoming.items():
            touched = sorted(r[0] for r in rows.select(bucket(t).alias("b")).distinct().collect())  # BUCKETS at most
            if not touched:
                continue
            out = apply[t](self._table(version, t, touched))
            kind = schema.TABLES[t]
            out = out.select(*[F.col(f.name).cast(f.dataType) for f in kind]).withColumn("bucket", bucket(t))
            out.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/data/{name}/{t}")
            fs = self._fs()
            for b in touched:
                if fs.exists(self._path(f"data/{name}/{t}/bucket={b}")):
                    new[t][str(b)] = f"data/{name}/{t}/bucket={b}"
                else:
                    new[t].pop(str(b), None)
        if not self._create(f"versions/{latest + 1:012d}", json.dumps(new)):
            raise Conflict(f"version {latest + 1} has been made by another writer")
        return latest + 1

    def compact(self) -> None:
        """Delete what the current version doesn't name: earlier versions and files of saves that did not end. No save or reader may run."""
        number, version = self.current()
        fs = self._fs()
        kept = {folder.split("/")[1] for t in version.values() for folder in t.values()}
        if fs.exists(self._path("data")):
            for f in fs.listStatus(self._path("data")):
                if f.getPath().getName() not in kept:
                    fs.delete(f.getPath(), True)
        for n in self._versions():
            if n < number:
                fs.delete(self._path(f"versions/{n:012d}"), False)

    def batch_time(self, batch: str) -> Column:
        """The wall time at which a batch was first begun; the same whenever it runs again."""
        now = self.spark.range(1).select(F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss.SSSSSS")).first()[0]
        name = f"batches/{batch}"
        if not self._create(name, json.dumps(now)):
            try:
                now = json.loads(self._read(name))
            except ValueError:  # cut off by a crash before anything was saved with it
                self._fs().delete(self._path(name), False)
                self._create(name, json.dumps(now))
        return F.lit(now).cast("timestamp")

    def save(self, registry: str, repository: str, manifests: DataFrame, tags: DataFrame, findings: DataFrame, run: DataFrame | None, at: Column, raw: bool = False) -> int:
        """One scan, in order: repository, manifests, tags, findings with their occurrences, run.

        manifests: digest, root_digest, platform_*, status, error. tags: as state.tag_records gives them. findings: detailed,
        actionable and suppressed. run: a row of scan_runs without id and repository_id (None: no run). Raises InvalidRecord before anything is written.
        """
        for what, bad in state.invalid_records(self.spark, registry, repository, manifests, tags, findings, run):
            if not bad.isEmpty():
                raise InvalidRecord(what)
        own = {"registry": F.lit(registry), "repository": F.lit(repository)}
        repo = self.spark.range(1).select(*[c.alias(k) for k, c in own.items()])
        in_repo = lambda df: df.withColumns(own).withColumn("repository_id", state.key_id("registry", "repository")).drop(*own)
        scans = manifests.withColumnsRenamed({"status": "last_scan_status", "error": "last_scan_error"})
        links = in_repo(scans.select(F.col("digest").alias("manifest_digest"), "root_digest", "last_scan_status", "last_scan_error"))
        tags = in_repo(tags)
        f = fnd.persisted(fnd.dedup_detailed(findings), raw)
        parts = F.split("platform", "/")
        part = lambda i: F.coalesce(F.get(parts, F.lit(i)), F.lit(""))
        occ = f.withColumns({"finding_id": state.key_id("manifest_digest", "fingerprint"), "source_key": F.col("key"), "platform_os": part(0), "platform_architecture": part(1), "platform_variant": part(2), "match_start": F.col("match_start").cast("int"), "match_end": F.col("match_end").cast("int"), "line_number": F.col("line_number").cast("int")})
        incoming = {"repositories": repo, "manifests": scans.drop("root_digest"), "repository_manifests": links, "tags": tags, "findings": f, "finding_occurrences": occ}
        apply = {
            "repositories": lambda t: state.upsert_repositories(t, repo, at),
            "manifests": lambda t: state.upsert_manifests(t, incoming["manifests"], at),
            "repository_manifests": lambda t: state.upsert_repository_manifests(t, links, at),
            "tags": lambda t: state.replace_tags(t, tags, at),
            "findings": lambda t: state.upsert_findings(t, f, at),
            "finding_occurrences": lambda t: state.upsert_occurrences(t, occ, at),
        }
        if run is not None:
            incoming["scan_runs"] = in_repo(run).withColumn("id", F.expr("xxhash64(repository_id, requested_reference, scanned_at, result_json) & 9223372036854775807L"))
            apply["scan_runs"] = lambda t: state.append_runs(t, incoming["scan_runs"])
        return self.update(incoming, apply)


def result_json(findings: DataFrame) -> DataFrame:
    """Public findings as one JSON text per row, times in RFC 3339."""
    return findings.select(F.to_json(F.struct(*fnd.PUBLIC)).alias("json"))


def findings_rows(findings: DataFrame, raw: bool = False) -> DataFrame:
    """Persisted findings, low confidence capped, in order: actionable before suppressed."""
    out = fnd.cap_low_confidence(fnd.persisted(fnd.dedup_detailed(findings), raw), fnd.DETAIL_ORDER)
    keep = out if raw else out.drop("value", "raw_snippet")
    return keep.orderBy(F.col("disposition") != "actionable", *fnd.DETAIL_ORDER)


def write_findings_file(findings: DataFrame, folder: str, name: str, raw: bool = False) -> str:
    """One array in a local file that its owner alone may read. Rows go through the driver one partition at a time, none is kept."""
    os.makedirs(folder, mode=0o700, exist_ok=True)
    path = os.path.join(folder, name)
    with open(os.open(path, os.O_CREAT | os.O_WRONLY | os.O_TRUNC, 0o600), "w", encoding="utf-8") as out:
        out.write("[")
        rows = findings_rows(findings, raw)
        for n, r in enumerate(rows.select(F.to_json(F.struct(*rows.columns)).alias("json")).toLocalIterator()):
            out.write(("," if n else "") + "\n  " + r["json"])
        out.write("\n]\n")
    return path


def findings_file_name(at: Column, reference: Column) -> Column:
    return F.concat(F.date_format(at, "yyyyMMdd'T'HHmmss'Z'"), F.lit("-"), scalar.path_token(reference), F.lit(".json"))
