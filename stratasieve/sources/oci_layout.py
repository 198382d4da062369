"""Images in an OCI layout folder (index.json and blobs/sha256), read with Spark's binary files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def index(spark: SparkSession, root: str) -> DataFrame:
    """body and header_type of the layout's index."""
    f = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/index.json")
    return f.select(F.col("content").cast("string").alias("body"), F.lit("application/vnd.oci.image.index.v1+json").alias("header_type"))


#: more bytes than this do not fit in one cell
MOST = (1 << 31) - 1


def _files(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    """digest, length and content of the named blobs that are there; only these files are opened."""
    folder = f"{root.rstrip('/')}/blobs/sha256"
    digest = F.concat(F.lit("sha256:"), F.substring_index("path", "/", -1)).alias("digest")
    there = spark.read.format("binaryFile").load(f"{folder}/*").select(digest, "path", "length")  # a listing: contents are not read
    wanted = spark.createDataFrame([(n,) for n in names], "digest string")
    paths = [r["path"] for r in there.join(F.broadcast(wanted), "digest", "left_semi").where(F.col("length") <= MOST).collect()]
    if not paths:
        return spark.createDataFrame([], "digest string, length long, content binary")
    return spark.read.format("binaryFile").load(paths).select(digest, "length", "content")


def _names(wanted: DataFrame, column: str) -> list[str]:
    return sorted({r[0] for r in wanted.select(column).distinct().collect() if r[0]})  # as many as the layout's index leads to


def documents(spark: SparkSession, root: str, wanted: DataFrame) -> DataFrame:
    """digest, body and error of manifests and configurations."""
    return _files(spark, root, _names(wanted, "digest")).select("digest", F.col("content").cast("string").alias("body"), F.lit("").alias("error"))


def layers(spark: SparkSession, root: str, kinds: DataFrame) -> DataFrame:
    """layer_digest, media_type and blob; a blob that is missing or too long for a cell is null, and then an unreadable layer."""
    f = _files(spark, root, _names(kinds, "layer_digest"))
    return kinds.join(f.select(F.col("digest").alias("layer_digest"), F.col("content").alias("blob")), "layer_digest", "left")
