"""The state tables: upserts as joins that give new snapshots, and the records that go into them.

Each function takes the table as it is and what comes in, and returns the table as it shall be. Rows are matched by their natural
keys; ids are 64-bit hashes of the keys, so a repeated or retried run gives the same ids. first_seen_at stays,
last_seen_at is the last writer's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import scalar


def key_id(*cols: str) -> Column:
    """Surrogate id of a natural key: never negative."""
    return F.expr(f"xxhash64({', '.join(cols)}) & 9223372036854775807L")


def _one(incoming: DataFrame, keys: list[str]) -> DataFrame:
    """One incoming row per key: the last in order of all its columns."""
    rest = [c for c in incoming.columns if c not in keys]
    return incoming.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("row")).select(*keys, "row.*") if rest else incoming.distinct()


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], update: dict[str, Column] | None = None) -> DataFrame:
    """Rows of existing, those whose key comes in with the columns of `update` (functions of old.* and new.*), and new rows."""
    new = _one(incoming, keys)
    on = [F.col(f"old.{k}") == F.col(f"new.{k}") for k in keys]
    joined = existing.alias("old").join(new.alias("new"), on, "full_outer")
    was, comes = F.col(f"old.{keys[0]}").isNotNull(), F.col(f"new.{keys[0]}").isNotNull()
    out = []
    for c in existing.columns:
        kept = F.when(comes, update[c]).otherwise(F.col(f"old.{c}")) if update and c in update else F.col(f"old.{c}")
        out.append(F.when(was, kept).otherwise(F.col(f"new.{c}") if c in new.columns else F.lit(None)).alias(c))
    return joined.select(*out)


def _seen(incoming: DataFrame, at: Column) -> DataFrame:
    return incoming.withColumns({"first_seen_at": at, "last_seen_at": at})


NEW = lambda c: F.col(f"new.{c}")


def upsert_repositories(existing: DataFrame, incoming: DataFrame, at: Column) -> DataFrame:
    """incoming: registry, repository."""
    rows = _seen(incoming.select("registry", "repository").distinct(), at).withColumn("id", key_id("registry", "repository"))
    return upsert(existing, rows, schema.KEYS["repositories"], {"last_seen_at": NEW("last_seen_at")})


def upsert_manifests(existing: DataFrame, incoming: DataFrame, at: Column) -> DataFrame:
    """incoming: digest, platform_*, last_scan_status, last_scan_error. A blank platform field doesn't overwrite."""
    keep = {c: F.when(~scalar.blank(NEW(c)), NEW(c)).otherwise(F.col(f"old.{c}")) for c in ("platform_os", "platform_architecture", "platform_variant")}
    return upsert(existing, _seen(incoming, at), schema.KEYS["manifests"], keep | {c: NEW(c) for c in ("last_seen_at", "last_scan_status", "last_scan_error")})


def upsert_repository_manifests(existing: DataFrame, incoming: DataFrame, at: Column) -> DataFrame:
    """incoming: repository_id, manifest_digest, root_digest, last_scan_status, last_scan_error."""
    return upsert(existing, _seen(incoming, at), schema.KEYS["repository_manifests"], {c: NEW(c) for c in ("root_digest", "last_seen_at", "last_scan_status", "last_scan_error")})


def replace_tags(existing: DataFrame, incoming: DataFrame, at: Column) -> DataFrame:
    """All rows of the incoming tag names go, the incoming ones come (so first_seen_at starts anew). One row per key stays."""
    touched = incoming.select("repository_id", "tag").distinct()
    rows = _one(_seen(incoming, at), schema.KEYS["tags"])
    return existing.join(touched, ["repository_id", "tag"], "left_anti").select(*existing.columns).unionByName(rows.select(*existing.columns))


def upsert_findings(existing: DataFrame, incoming: DataFrame, at: Column) -> DataFrame:
    """incoming: manifest_digest, fingerprint, redacted_value, value. A blank value overwrites: raw values are gone once they aren't kept."""
    rows = _seen(incoming.select("manifest_digest", "fingerprint", "redacted_value", "value"), at).withColumn("id", key_id("manifest_digest", "fingerprint"))
    return upsert(existing, rows, schema.KEYS["findings"], {c: NEW(c) for c in ("redacted_value", "value", "last_seen_at")})


def upsert_occurrences(existing: DataFrame, incoming: DataFrame, at: Column) -> DataFrame:
    """incoming: the key of 16 columns, disposition, disposition_reason and line_number."""
    keys = schema.KEYS["finding_occurrences"]
    rows = _seen(incoming.select(*keys, "disposition", "disposition_reason", "line_number"), at).withColumn("id", key_id(*keys))
    return upsert(existing, rows, keys, {c: NEW(c) for c in ("disposition", "disposition_reason", "line_number", "last_seen_at")})


def append_runs(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    return existing.unionByName(incoming.select(*existing.columns))


def group_tags(resolved: DataFrame) -> DataFrame:
    """A row per root digest with its sorted tags, the first tag and their number."""
    g = resolved.groupBy("digest").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    return g.select("digest", "tags", F.element_at("tags", 1).alias("first_tag"), F.size("tags").cast("long").alias("tag_count"))


def tag_records(targets: DataFrame, failed: DataFrame) -> DataFrame:
    """Tags of each target times its manifests, and the failed tags; each once.

    targets: tags (array), root_digest, manifests (array of digest, os, architecture, variant, status, error). failed: tag, error.
    """
    t = targets.select(F.explode("tags").alias("tag"), "root_digest", F.explode_outer("manifests").alias("m"))
    none = lambda c: F.coalesce(c, F.lit(""))
    done = t.select(F.trim("tag").alias("tag"), "root_digest", none(F.col("m.digest")).alias("manifest_digest"), none(F.col("m.os")).alias("platform_os"), none(F.col("m.architecture")).alias("platform_architecture"), none(F.col("m.variant")).alias("platform_variant"), F.coalesce("m.status", F.lit("failed")).alias("status"), none(F.col("m.error")).alias("error"))
    empty = {c: F.lit("") for c in ("root_digest", "manifest_digest", "platform_os", "platform_architecture", "platform_variant")}
    bad = failed.select(F.trim("tag").alias("tag"), F.lit("failed").alias("status"), "error").withColumns(empty)
    return done.unionByName(bad).distinct()


def merge_manifests(records: DataFrame) -> DataFrame:
    """One row per digest of records (digest, root_digest, platform_*, status, error, ord), in the order of ord.

    The first non-blank root and platform fields stay; `scanned` wins and clears the error; else the last error that isn't blank.
    """
    r = records.withColumns({c: F.trim(F.coalesce(c, F.lit(""))) for c in ("digest", "root_digest", "platform_os", "platform_architecture", "platform_variant", "status", "error")}).where("digest <> ''")
    r = r.withColumn("status", F.when(F.col("status") == "", "scanned").otherwise(F.col("status"))).withColumn("root_digest", F.when(F.col("root_digest") == "", F.col("digest")).otherwise(F.col("root_digest")))
    first = lambda c: F.coalesce(F.min_by(F.col(c), F.when(F.col(c) != "", F.col("ord"))), F.lit(""))
    scanned = F.max(F.col("status") == "scanned")
    g = r.groupBy("digest").agg(*[first(c).alias(c) for c in ("root_digest", "platform_os", "platform_architecture", "platform_variant")], scanned.alias("ok"), F.min_by("status", "ord").alias("first_status"), F.max_by("error", F.when(F.col("error") != "", F.col("ord"))).alias("e"))
    return g.select("digest", "root_digest", "platform_os", "platform_architecture", "platform_variant", F.when(F.col("ok"), "scanned").otherwise(F.col("first_status")).alias("status"), F.when(F.col("ok"), "").otherwise(F.coalesce("e", F.lit(""))).alias("error"))


def run_status(error: Column, limit: Column, failed: Column) -> Column:
    """partial at a limit or with anything failed, failed at another error, else completed."""
    return F.when(~scalar.blank(error) & limit, "partial").when(~scalar.blank(error), "failed").when(failed > 0, "partial").otherwise("completed")


def invalid(table: str, rows: DataFrame) -> DataFrame:
    """Rows that may not be saved: a null anywhere, or a blank key."""
    bad = F.lit(False)
    for c in rows.columns:
        bad = bad | F.col(c).isNull()
    for k in schema.KEYS.get(table, [])[:1]:
        bad = bad | scalar.blank(F.col(k).cast("string"))
    return rows.where(bad)


STATUSES, RUN_STATUSES = ("scanned", "failed"), ("completed", "partial", "failed")


def invalid_records(spark: SparkSession, registry: str, repository: str, manifests: DataFrame, tags: DataFrame, findings: DataFrame, run: DataFrame | None) -> list[tuple[str, DataFrame]]:
    """What a save must not hold: a name, and the rows at fault."""
    one = spark.range(1)
    status = lambda c, allowed: ~F.coalesce(F.trim(c).isin(*allowed), F.lit(False))
    out = [
        ("registry and repository are required", one.where(F.lit(not registry.strip() or not repository.strip()))),
        ("a manifest needs a digest", manifests.where(scalar.blank(F.col("digest")))),
        ("a manifest is scanned or failed", manifests.where(status(F.col("status"), STATUSES))),
        ("a tag needs a name", tags.where(scalar.blank(F.col("tag")))),
        ("a tag is scanned or failed", tags.where(status(F.col("status"), STATUSES))),
        ("a finding needs a manifest digest", findings.where(scalar.blank(F.col("manifest_digest")))),
        ("a finding needs a fingerprint", findings.where(scalar.blank(F.col("fingerprint")))),
    ]
    if run is not None:
        out += [("a run is completed, partial or failed", run.where(status(F.col("status"), RUN_STATUSES))), ("a run's result is JSON", run.where(F.try_parse_json("result_json").isNull())), ("a run has a time", run.where(F.col("scanned_at").isNull()))]
    return out


def delete_cascade(tables: dict[str, DataFrame], repository_ids: DataFrame) -> dict[str, DataFrame]:
    """Without some repositories and what hangs on them."""
    ids = repository_ids.select(F.col("id").alias("repository_id")).distinct()
    out = dict(tables)
    out["repositories"] = tables["repositories"].join(ids.withColumnRenamed("repository_id", "id"), "id", "left_anti").select(*tables["repositories"].columns)
    for t in ("repository_manifests", "tags", "scan_runs"):
        out[t] = tables[t].join(ids, "repository_id", "left_anti").select(*tables[t].columns)
    return out
