"""Manifests and image configurations: parse, select platforms, flatten into content rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import scalar

# Media types.
INDEX_TYPES = ("application/vnd.oci.image.index.v1+json", "application/vnd.docker.distribution.manifest.list.v2+json")
MANIFEST_TYPES = ("application/vnd.oci.image.manifest.v1+json", "application/vnd.docker.distribution.manifest.v2+json")
ACCEPTED = MANIFEST_TYPES[::-1] + INDEX_TYPES[::-1]
PLAIN_LAYERS = ("application/vnd.oci.image.layer.v1.tar", "application/vnd.docker.image.rootfs.diff.tar")
GZIP_LAYERS = ("application/vnd.oci.image.layer.v1.tar+gzip", "application/vnd.docker.image.rootfs.diff.tar.gzip")
ZSTD_LAYERS = ("application/vnd.oci.image.layer.v1.tar+zstd", "application/vnd.docker.image.rootfs.diff.tar.zstd")
FOREIGN_LAYERS = ("application/vnd.oci.image.layer.nondistributable.v1.tar", "application/vnd.oci.image.layer.nondistributable.v1.tar+gzip", "application/vnd.oci.image.layer.nondistributable.v1.tar+zstd", "application/vnd.docker.image.rootfs.foreign.diff.tar.gzip")


def media_type(value: Column) -> Column:
    """Without parameters, trimmed."""
    return F.trim(F.substring_index(F.coalesce(value, F.lit("")), ";", 1))


def is_index(t: Column) -> Column:
    return t.isin(*INDEX_TYPES)


def is_manifest(t: Column) -> Column:
    return t.isin(*MANIFEST_TYPES)


def compression(t: Column) -> Column:
    """none, gzip, zstd, foreign or unknown."""
    return F.when(t.isin(*PLAIN_LAYERS), "none").when(t.isin(*GZIP_LAYERS), "gzip").when(t.isin(*ZSTD_LAYERS), "zstd").when(t.isin(*FOREIGN_LAYERS), "foreign").otherwise("unknown")


def parse_documents(df: DataFrame) -> DataFrame:
    """body (JSON) and header_type with doc (struct), media_type and kind: index, manifest or null if it is neither."""
    doc = F.from_json("body", schema.MANIFEST)
    has = lambda name: F.get_json_object("body", f"$.{name}").isNotNull()
    t = scalar.first_non_blank(F.col("doc.mediaType"), media_type(F.col("header_type")))
    kind = F.when(has("manifests") | is_index(F.col("media_type")), "index").when(has("config") | has("layers") | is_manifest(F.col("media_type")), "manifest")
    return df.withColumn("doc", doc).withColumn("media_type", t).withColumn("kind", kind)


def parse_configs(df: DataFrame) -> DataFrame:
    """body with cfg, the configuration."""
    return df.withColumn("cfg", F.from_json("body", schema.CONFIG))


def attestation(d: Column) -> Column:
    """Whether a descriptor is no image: an attestation, an artifact, or of an unknown platform."""
    unknown = lambda c: F.coalesce(F.lower(F.trim(c)) == "unknown", F.lit(False))
    marked = F.coalesce(F.element_at(d["annotations"], "vnd.docker.reference.type") == "attestation-manifest", F.lit(False))
    return marked | ~scalar.blank(d["artifactType"]) | (unknown(d["platform"]["os"]) & unknown(d["platform"]["architecture"]))


def platform_matches(os: Column, architecture: Column, variant: Column, selector: tuple[str, str, str]) -> Column:
    """Without regard to case; a blank os or architecture never matches; the variant counts only if the selector has one."""
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    o, a, v = selector
    if not o or not a:
        return F.lit(False)
    out = (low(os) == o.lower()) & (low(architecture) == a.lower())
    return out & (low(variant) == v.lower()) if v else out


def select_descriptors(documents: DataFrame, selector: tuple[str, str, str] | None = None) -> DataFrame:
    """A row per image manifest of each index (doc as parse_documents gives it), without attestations, for the selected platform: d and its position."""
    d = documents.where("kind = 'index'").select("*", F.posexplode("doc.manifests").alias("position", "d"))
    d = d.where(is_manifest(media_type(F.col("d.mediaType"))) & ~attestation(F.col("d")))
    if selector:
        p = F.col("d.platform")
        d = d.where(platform_matches(p["os"], p["architecture"], p["variant"], selector))
    return d


def filled_platform(descriptor: Column, cfg: Column) -> dict[str, Column]:
    """os, architecture and variant of the descriptor, each blank one from the configuration."""
    return {k: scalar.first_non_blank(descriptor[k], cfg[k]) for k in ("os", "architecture", "variant")}


def flatten_env(df: DataFrame) -> DataFrame:
    """A row per entry of cfg.config.Env, in order of the text: key (trimmed, before the first `=`), match_key (untrimmed) and the whole entry as content."""
    e = df.select("*", F.explode(F.array_sort(F.col("cfg.config.Env"))).alias("content")).drop("cfg")
    raw = F.substring_index("content", "=", 1)
    return e.select("*", F.lit("env").alias("source_type"), F.trim(raw).alias("key"), raw.alias("match_key"))


def flatten_labels(df: DataFrame) -> DataFrame:
    """A row per label: key and `key=value` as content."""
    e = df.select("*", F.explode(F.array_sort(F.map_entries("cfg.config.Labels"))).alias("e")).drop("cfg")
    return e.select("*", F.lit("label").alias("source_type"), F.col("e.key").alias("key"), F.col("e.key").alias("match_key"), F.concat("e.key", F.lit("="), "e.value").alias("content")).drop("e")


def flatten_history(df: DataFrame) -> DataFrame:
    """A row per history entry and field that isn't blank, with key history[i].field."""
    h = df.select("*", F.posexplode("cfg.history").alias("i", "h")).drop("cfg")
    fields = F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"h.{f}").alias("content")) for f in ("created_by", "comment", "author")])
    h = h.withColumn("x", F.explode(fields)).where(~scalar.blank(F.col("x.content")))
    key = F.concat(F.lit("history["), F.col("i").cast("string"), F.lit("]."), F.col("x.f"))
    return h.select("*", F.lit("history").alias("source_type"), key.alias("key"), key.alias("match_key"), F.col("x.content").alias("content")).drop("i", "h", "x")


def flatten_config(df: DataFrame) -> DataFrame:
    """A row per other field of the configuration that isn't blank, trimmed, with its dotted key."""
    one = lambda key, c: F.array(F.struct(F.lit(key).alias("key"), c.alias("content")))
    parts = [one("author", F.col("cfg.author")), one("container", F.col("cfg.container"))]
    empty = F.array().cast("array<struct<key:string,content:string>>")
    for name in ("config", "container_config"):
        p = F.col(f"cfg.{name}")
        parts += [one(f"{name}.{k}", p[c]) for k, c in (("hostname", "Hostname"), ("domainname", "Domainname"), ("user", "User"), ("working_dir", "WorkingDir"))]
        for k, c in (("cmd", "Cmd"), ("entrypoint", "Entrypoint"), ("shell", "Shell"), ("onbuild", "OnBuild")):
            parts.append(F.expr(f"transform(cfg.{name}.{c}, (v, i) -> struct('{name}.{k}[' || i || ']' as key, v as content))"))
        for k, c in (("exposed_ports", "ExposedPorts"), ("volumes", "Volumes")):
            parts.append(F.expr(f"transform(array_sort(map_keys(cfg.{name}.{c})), v -> struct('{name}.{k}' as key, v as content))"))
    e = df.withColumn("x", F.explode(F.concat(*[F.coalesce(x, empty) for x in parts]))).drop("cfg").where(~scalar.blank(F.col("x.content")))
    return e.select("*", F.lit("config").alias("source_type"), F.col("x.key").alias("key"), F.col("x.key").alias("match_key"), F.trim("x.content").alias("content")).drop("x")


def flatten(df: DataFrame) -> DataFrame:
    """All content rows of the configurations."""
    return flatten_env(df).unionByName(flatten_labels(df)).unionByName(flatten_history(df)).unionByName(flatten_config(df))
