"""The corpus pipeline: quality classifier, near-duplicates, repeated passages, decontamination, mixing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which
is written as Parquet and reread as the next one's docs. Every stage works on all that its predecessor
kept. All but the last return the columns of documents; the last adds source_size and target (words of the source that are
left, and those it shall have) and copies, the times the mix repeats a document (at least 1; documents that it takes 0
times are not returned).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratasieve.llm import decontaminate, mixing, near_dedup, quality_classifier, suffix_dedup
from stratasieve.llm.common import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject (score >= 0.3)."""
    return quality_classifier.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the least id. Similarity 0.8 or more."""
    return near_dedup.drop_near_duplicates(docs, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words or more that stand earlier in the corpus."""
    return suffix_dedup.cut_repeats(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix, each with its number of copies."""
    return mixing.copies(docs).where(F.col("copies") > 0)


STAGES = [
    ("quality classifier", quality),
    ("near-duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("benchmark decontamination", benchmark),
    ("mixing", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: the classifier's trees and lasso are no SQL; tests/llm compares run() with brute force
ORACLE_SQL = None
QUERIES = {"pipeline": run}
SQL: dict = {}
