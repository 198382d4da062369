"""The scan: an image, or a repository's tags, to findings, manifests, tags and counts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..functions.references import parse_platform
from ..operators import detect as det
from ..operators import findings as fnd
from ..operators import metadata as meta
from ..operators import replay as rep
from ..operators import state
from ..sources import layers as lay
from ..sources import oci_layout
from ..sources.config import Settings


@dataclass
class Scan:
    """What a scan found. findings are detailed and deduplicated; manifests have a status, and an error where it is failed; targets are root documents times their manifests, in order."""

    findings: DataFrame
    manifests: DataFrame
    tags: DataFrame
    targets: DataFrame

    def saved(self, folder: str) -> "Scan":
        """The same, written once and read from there: what asks for it several times does not scan again."""
        read = {}
        for name in ("findings", "manifests", "tags", "targets"):
            df = getattr(self, name)
            df.write.mode("overwrite").parquet(f"{folder}/{name}")
            read[name] = df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")
        return Scan(**read)

    def counts(self) -> dict[str, int]:
        """Counters of the run: one aggregate over findings, one over targets."""
        act, sup = F.col("disposition") == "actionable", F.col("disposition") == "example"
        some = lambda c: F.count_distinct(F.when(c & ~scalar.blank(F.col("fingerprint")), F.col("fingerprint")))
        f = self.findings.agg(F.count(F.when(act, 1)).alias("total_findings"), some(act).alias("unique_fingerprints"), F.count(F.when(sup, 1)).alias("suppressed_findings_count"), some(sup).alias("suppressed_unique_fingerprints")).first()
        return f.asDict() | target_counts(self.targets).first().asDict()

    def status(self, counts: dict[str, int] | None = None, error: str = "", limit: bool = False) -> str:
        """completed, partial or failed (state.run_status)."""
        c = counts or self.counts()
        failed = c["failed_manifest_count"] + c["failed_target_count"] + c.get("tags_failed", 0)
        return self.findings.sparkSession.range(1).select(state.run_status(F.lit(error), F.lit(limit), F.lit(failed)).alias("s")).first()["s"]

    def exit_code(self, error: str = "") -> int:
        """1 after an error, 2 with findings, else 0."""
        return 1 if error else 2 if self.counts()["total_findings"] else 0

    def summary(self) -> DataFrame:
        """A row per manifest: platform, status, and its findings by disposition."""
        f = self.findings.groupBy("manifest_digest").agg(F.count(F.when(F.col("disposition") == "actionable", 1)).alias("actionable"), F.count(F.when(F.col("disposition") == "example", 1)).alias("suppressed"))
        m = self.manifests.select(F.col("digest").alias("manifest_digest"), scalar.platform_name(F.col("platform_os"), F.col("platform_architecture"), F.col("platform_variant")).alias("platform"), "status", "error")
        return m.join(f, "manifest_digest", "left").fillna(0, ["actionable", "suppressed"]).orderBy("platform", "manifest_digest")


def target_counts(targets: DataFrame) -> DataFrame:
    """One row: manifests (each counted with every target that has it) and targets; a target without a scanned manifest is failed."""
    done = F.count(F.when(F.col("status") == "scanned", 1))
    per = targets.groupBy("root_digest").agg(F.count(F.when(F.col("digest") != "", 1)).alias("n"), done.alias("ok"), F.count(F.when((F.col("digest") != "") & (F.col("status") != "scanned"), 1)).alias("bad"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return per.agg(F.count("*").alias("target_count"), F.count(F.when(F.col("ok") > 0, 1)).alias("completed_target_count"), F.count(F.when(F.col("ok") == 0, 1)).alias("failed_target_count"), total("n").alias("manifest_count"), total("ok").alias("completed_manifest_count"), total("bad").alias("failed_manifest_count"))


def detect_findings(content_rows: DataFrame, more: tuple = (), library: tuple = ()) -> DataFrame:
    """Content rows to detailed findings, deduplicated. more, library: a user's own rules (operators.detect)."""
    rows = content_rows.withColumn("content", F.col("content").cast("binary"))
    return fnd.dedup_detailed(fnd.normalise(det.detect(rows, more=more, library=library)))


Fetch = Callable[[DataFrame], DataFrame]


def scan_images(roots: DataFrame, fetch: Fetch, layers: Fetch, selector: tuple[str, str, str] | None = None, settings: Settings = Settings(), failed: DataFrame | None = None, more: tuple = (), library: tuple = (), written: Callable[[DataFrame, str], DataFrame] = lambda df, name: df) -> Scan:
    """roots: tag, digest, body, header_type and error of root documents (a null body: not read). fetch: digest and what (manifest or blob) to digest, body and error. layers: layer_digest and media_type to schema.LAYER_ENTRIES. failed: tag and error of tags without a root.

    A digest is scanned once, however many tags name it; a layer is decoded once, however many manifests share it. A limit ends the scan: targets are in the order of
    their first tag, and of those behind the first that met a limit nothing is kept; nor of its manifests behind that one. written: writes a table under a name and reads it
    back, for what is used several times (as it is: each use computes it again).
    """
    spark = roots.sparkSession
    one = roots.groupBy("digest").agg(F.first("body", True).alias("body"), F.first("header_type", True).alias("header_type"), F.max("error").alias("root_error"), F.coalesce(F.min(F.when(F.col("tag") != "", F.col("tag"))), F.lit("")).alias("first_tag"))
    docs = written(meta.parse_documents(one).withColumnRenamed("digest", "root_digest"), "roots")
    below = meta.select_descriptors(docs, selector).select("root_digest", F.col("position"), F.col("d.digest").alias("digest"), F.col("d.platform").alias("p"))
    got = fetch(below.select("digest", F.lit("manifest").alias("what")).distinct()).select("digest", "body", F.col("error").alias("fetch_error"))
    found = below.join(got, "digest", "left").withColumn("header_type", F.lit(""))
    no_platform = F.lit(None).cast("struct<os:string,architecture:string,variant:string>")
    direct = docs.where("kind = 'manifest'").select("root_digest", F.lit(0).alias("position"), F.col("root_digest").alias("digest"), no_platform.alias("p"), "body", F.lit("").alias("fetch_error"), "header_type")
    mans = found.select("root_digest", "position", "digest", "p", "body", "fetch_error", "header_type").unionByName(direct)
    mans = written(meta.parse_documents(mans.dropDuplicates(["root_digest", "digest"])).withColumn("config_digest", F.col("doc.config.digest")), "manifest-documents")
    per = mans.withColumn("by", F.struct("root_digest", "position")).groupBy("digest").agg(*[F.min_by(c, "by").alias(c) for c in ("root_digest", "p", "body", "fetch_error", "kind", "doc", "config_digest")])
    wanted = per.where("config_digest <> ''").select(F.col("config_digest").alias("digest"), F.lit("blob").alias("what")).distinct()
    cfg = fetch(wanted).select(F.col("digest").alias("config_digest"), F.col("body").alias("cfg_body"), F.octet_length(F.col("body")).alias("cfg_size"), F.col("error").alias("cfg_error"))
    per = per.join(cfg, "config_digest", "left")
    too_big = (F.lit(settings.max_config_bytes > 0) & (F.col("cfg_size") > settings.max_config_bytes)) | F.coalesce(F.col("cfg_error").startswith("limit"), F.lit(False))
    per = per.withColumn("too_big", F.coalesce(too_big, F.lit(False)))
    per = per.withColumn("cfg", F.when(~F.col("too_big"), F.from_json("cfg_body", meta.schema.CONFIG)))
    per = per.withColumn("f", F.struct(*[c.alias(k) for k, c in meta.filled_platform(F.col("p"), F.col("cfg")).items()]))
    per = written(per.withColumn("platform", scalar.platform_name(F.col("f.os"), F.col("f.architecture"), F.col("f.variant"))), "manifests-and-configurations")
    ml = per.where("kind = 'manifest'").select(F.col("digest").alias("manifest_digest"), F.posexplode("doc.layers").alias("layer_idx", "l")).select("manifest_digest", "layer_idx", F.col("l.digest").alias("layer_digest"), F.col("l.mediaType").alias("media_type"))
    decoded = layers(ml.groupBy("layer_digest").agg(F.max("media_type").alias("media_type")))
    broken = decoded.where("kind = 'error'").select("layer_digest", "path").join(ml, "layer_digest").groupBy("manifest_digest").agg(F.min_by("path", "layer_idx").alias("layer_error"), F.min("layer_idx").alias("bad_layer"))
    # what stands before an unreadable layer is kept
    usable = ml.join(broken, "manifest_digest", "left").where("bad_layer is null or layer_idx <= bad_layer").select("manifest_digest", "layer_idx", "layer_digest")
    files = rep.content_rows(rep.replay(usable, decoded), decoded, per.select(F.col("digest").alias("manifest_digest"), "platform"))
    cols = ["source_type", "manifest_digest", "platform", "file_path", "layer_digest", "key", "present_in_final_image", "content"]
    about = meta.flatten(per.where("cfg is not null").select(F.col("digest").alias("manifest_digest"), "platform", "cfg")).withColumns({"file_path": F.lit(""), "layer_digest": F.lit(""), "present_in_final_image": F.lit(False), "content": F.col("content").cast("binary")})
    lost = F.when(~scalar.blank(F.col("fetch_error")), F.col("fetch_error")).when(F.col("body").isNull(), "manifest is missing").when(F.col("kind").isNull(), "document is neither index nor manifest").when(F.col("too_big"), "limit: config bytes").when(~scalar.blank(F.col("cfg_error")), F.col("cfg_error")).when(F.col("cfg").isNull(), "config is missing").otherwise(F.col("layer_error"))
    state_of = per.join(broken.withColumnRenamed("manifest_digest", "digest"), "digest", "left").withColumn("error", F.coalesce(lost, F.lit("")))
    manifests = written(state_of.select("digest", "root_digest", F.col("f.os").alias("platform_os"), F.col("f.architecture").alias("platform_architecture"), F.col("f.variant").alias("platform_variant"), F.when(F.col("error") == "", "scanned").otherwise("failed").alias("status"), "error"), "manifest-states")

    # targets: roots in the order of their first tag, times their manifests; a root without any has one row with its error
    pairs = mans.select("root_digest", "position", "digest").join(manifests.select("digest", "status", "error"), "digest")
    why = F.when(~scalar.blank(F.col("root_error")), F.col("root_error")).when(F.col("body").isNull(), "document is missing").when(F.col("kind").isNull(), "document is neither index nor manifest").otherwise("no manifest is selected")
    targets = docs.select("root_digest", "first_tag", why.alias("why")).join(pairs, "root_digest", "left")
    targets = targets.select("first_tag", "root_digest", F.coalesce("position", F.lit(-1)).alias("position"), F.coalesce("digest", F.lit("")).alias("digest"), F.coalesce("status", F.lit("failed")).alias("status"), F.when(F.col("digest").isNull(), F.col("why")).otherwise(F.col("error")).alias("error"))
    place = F.struct("first_tag", "root_digest", "position")
    stop = targets.where(F.col("error").startswith("limit")).agg(F.min(place)).scalar()
    targets = written(targets.where(stop.isNull() | (place <= stop)), "target-states")
    kept = targets.where("digest <> ''").select("digest").distinct()
    manifests = manifests.join(kept, "digest", "left_semi")
    rows = files.select(*cols).unionByName(about.select(*cols)).join(kept.withColumnRenamed("digest", "manifest_digest"), "manifest_digest", "left_semi").select(*cols)
    findings = detect_findings(rows, more, library)
    grouped = roots.where("tag <> ''").groupBy("digest").agg(F.array_sort(F.collect_set("tag")).alias("tags")).withColumnRenamed("digest", "root_digest")
    m = manifests.select("digest", F.col("platform_os").alias("os"), F.col("platform_architecture").alias("architecture"), F.col("platform_variant").alias("variant"))
    by_root = targets.where("digest <> ''").join(m, "digest").groupBy("root_digest").agg(F.collect_list(F.struct("digest", "os", "architecture", "variant", "status", "error")).alias("manifests"))
    grouped = grouped.join(targets.select("root_digest").distinct(), "root_digest", "left_semi").join(by_root, "root_digest", "left")
    return Scan(findings, manifests, state.tag_records(grouped, failed if failed is not None else spark.createDataFrame([], "tag string, error string")), targets)


def scan_documents(roots: DataFrame, blobs: DataFrame, selector: tuple[str, str, str] | None = None, settings: Settings = Settings(), more: tuple = (), library: tuple = ()) -> Scan:
    """roots: tag, digest, body and header_type of root documents. blobs: digest and blob of everything below them."""
    text = blobs.select("digest", F.col("blob").cast("string").alias("body"), F.lit("").alias("error"))
    raw = blobs.select(F.col("digest").alias("layer_digest"), "blob")
    return scan_images(roots.withColumn("error", F.lit("")), lambda w: text.join(w, "digest", "left_semi"), lambda kinds: lay.decode(kinds.join(raw, "layer_digest"), settings), selector, settings, None, more, library)


def scan_layout(spark: SparkSession, root: str, platform: str = "", settings: Settings = Settings(), more: tuple = (), library: tuple = ()) -> Scan:
    """An OCI layout folder: every image that its index names, or those of one platform."""
    roots = oci_layout.index(spark, root).select(F.lit("latest").alias("tag"), F.concat(F.lit("sha256:"), F.sha2("body", 256)).alias("digest"), "body", "header_type", F.lit("").alias("error"))
    return scan_images(roots, lambda w: oci_layout.documents(spark, root, w), lambda kinds: lay.decode(oci_layout.layers(spark, root, kinds), settings), parse_platform(platform), settings, None, more, library)
