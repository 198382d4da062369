"""Findings kept up to date from a stream of content rows.

Detection is stateless, so each batch is scanned alone; its findings, and the manifests they are of, are saved under the batch's time: the wall time at which the batch was
first begun, kept in the store. A batch that runs again writes the same rows under the same ids and times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schema
from ..operators import findings as fnd
from ..plans.scan import detect_findings
from ..sources.store import Store


def stream_findings(rows: DataFrame) -> DataFrame:
    """Detailed findings of a streaming DataFrame of content rows, not deduplicated across batches."""
    from ..operators import detect as det

    return fnd.normalise(det.detect(rows))


def keep_up(spark: SparkSession, folder: str, store: Store, checkpoint: str, registry: str, repository: str, name: str = "content") -> StreamingQuery:
    """Read content rows of a repository's images from a folder of Parquet files as they come and save what is found in them. name tells streams into one store apart."""
    rows = spark.readStream.schema(schema.CONTENT_ROWS).parquet(folder)

    def batch(df: DataFrame, number: int) -> None:
        parts = F.split(F.coalesce("platform", F.lit("")), "/")
        part = lambda i: F.coalesce(F.get(parts, F.lit(i)), F.lit(""))
        seen = df.where("manifest_digest <> ''").groupBy("manifest_digest").agg(F.max("platform").alias("platform"))
        manifests = seen.select(F.col("manifest_digest").alias("digest"), F.col("manifest_digest").alias("root_digest"), part(0).alias("platform_os"), part(1).alias("platform_architecture"), part(2).alias("platform_variant"), F.lit("scanned").alias("status"), F.lit("").alias("error"))
        no_tags = spark.createDataFrame([], "tag string, manifest_digest string, root_digest string, platform_os string, platform_architecture string, platform_variant string, status string, error string")
        findings = detect_findings(df.where("manifest_digest <> ''"))
        store.save(registry, repository, manifests, no_tags, findings, None, store.batch_time(f"{name}-{number}"))

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
