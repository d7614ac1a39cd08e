"""Shared plumbing: durable intermediate tables, size-checked broadcasts, connected components."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of two or three narrow columns that may be broadcast; above it joins shuffle.
BROADCAST_ROWS = 200_000

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where a local session names none (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="loomtext-")
    return _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/loomtext/{name}-{uuid.uuid4().hex[:12]}"


def trim_driver(spark: SparkSession) -> bool:
    """Give back what the driver's JVM has freed outside its heap: planning and compiling on hundreds of threads
    leaves that scattered over the heaps of malloc. Whether the JVM can."""
    try:
        jvm = spark._jvm
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:  # not glibc, or a JVM without that command
        return False
    return True


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    trim_driver(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._loomtext_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what materialize() wrote, once nothing reads it any more."""
    path = getattr(df, "_loomtext_path", None)
    if path:
        fs, p = hadoop_fs(df.sparkSession, path)
        fs.delete(p, True)


def hadoop_fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a narrow table has at most so many rows; reads no more than that many."""
    return df.limit(rows + 1).count() <= rows


def join_sized(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a narrow right side: broadcast when its counted rows allow that, shuffled otherwise."""
    return left.join(F.broadcast(right) if small_enough(right, rows) else right.hint("merge"), on, how)


def crc_mod(doc_id: Column, mod: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(mod))


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def connected(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of the undirected edges (u, v); comp is the smallest node reachable.

    Alternates large-star and small-star steps, each a grouped minimum and a join back, until the edge
    set stops changing. Every round is written out, so a lost executor repeats one round at most.
    """
    cur = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = _state(cur)
    while seen[0]:
        both = cur.union(cur.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
        nxt = materialize(small.where("u <> v").distinct(), "edges")
        discard(cur)
        cur, now = nxt, _state(nxt)
        if now == seen:
            break
        seen = now
    return cur.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(cur.select(F.col("v").alias("node"), F.col("v").alias("comp"))).distinct()
