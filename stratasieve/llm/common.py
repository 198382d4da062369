"""Shared pieces of the training-data operators: scratch tables, safe joins, components."""

from __future__ import annotations

import atexit
import logging
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: bits of the filter that goes before a shuffled join, 16 MB of them at most whatever the size of the tables
FILTER_BITS = 1 << 27

_scratch: list[tuple[object, str]] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Only a local session (tests) makes one of its own; on a cluster its absence is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="stratasieve-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, and lost executors cost nothing done before."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _scratch:
        atexit.register(_clean)
    _scratch.append((spark.sparkContext._jsc.hadoopConfiguration(), path))
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete written tables that nothing lazy reads any more. The others go at the end of the program."""
    gone = {t._scratch for t in tables}
    for conf, path in _scratch:
        if path in gone:
            _delete(conf, path)
    _scratch[:] = [x for x in _scratch if x[1] not in gone]


def _delete(conf: object, path: str) -> None:
    p = SparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


def _clean() -> None:
    """At the end of the program; the JVM outlives a session that has been stopped."""
    for conf, path in _scratch:
        try:
            _delete(conf, path)
        except Exception as e:  # noqa: BLE001  nothing can be done here but to say what is left
            logging.getLogger(__name__).warning("not deleted: %s (%s)", path, e)


def columns(df: DataFrame, **types: str) -> DataFrame:
    """Only the named columns, cast (an id that is no number is null); a missing one is null. Other columns, whatever their names, are not carried along."""
    have = {c.lower(): c for c in df.columns}
    return df.select(*[(F.col(f"`{have[k]}`") if k in have else F.lit(None)).try_cast(t).alias(k) for k, t in types.items()])


def near(df: DataFrame, key: Column, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be among the hashes `key` of wanted, rows whose key is not).

    wanted becomes a bitmap of FILTER_BITS bits, a table of at most FILTER_BITS / 64 rows that is broadcast at every size of the input;
    only the first part, which holds every wanted row and few others, need be shuffled for the exact join that follows.
    Beyond some 10^8 wanted keys the bitmap fills up and the first part nears the whole table; the result is the same.
    """
    slot = lambda k: f"({k} & {FILTER_BITS - 1}L)"
    bits = wanted.selectExpr(f"{slot('key')} as s").groupBy(F.expr("shiftright(s, 6)").alias("word of the filter")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("bits of the filter"))
    bits = materialize(bits, "filter")
    d = df.withColumn("slot of the filter", key.bitwiseAND(F.lit(FILTER_BITS - 1).cast("long")))
    d = d.join(F.broadcast(bits), F.shiftright("slot of the filter", 6) == F.col("word of the filter"), "left")
    hit = F.expr("coalesce(shiftrightunsigned(`bits of the filter`, cast(`slot of the filter` & 63 as int)) & 1, 0) = 1")
    cols = [F.col(f"`{c}`") for c in df.columns]
    return d.where(hit).select(*cols), d.where(~hit).select(*cols)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id is as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def _stars(e: DataFrame) -> bool:
    """Whether every node of the edges u > v is either a centre (v) or once a member (u)."""
    roles = e.selectExpr("u as node", "1 as member", "0 as centre").union(e.selectExpr("v", "0", "1"))
    return roles.groupBy("node").agg(F.sum("member").alias("member"), F.max("centre").alias("centre")).where("member > 1 or member = 1 and centre = 1").isEmpty()


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    edges: a, b long. Returns node, component (the least node reached) for every node of an edge.
    Both sides of each join are written tables, so that a hub's rows can be split; minima are
    aggregated before they are shuffled. Ends when every node is a centre or has one centre.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = materialize(e, name)
    while not _stars(e):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), name)
        big = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        big = materialize(big, name)
        release(e, low)
        low = materialize(big.groupBy("u").agg(F.min("v").alias("m")), name)
        joined = big.join(low, "u")
        e = materialize(joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), name)
        release(big, low)
    out = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return out.union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
