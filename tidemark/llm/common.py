"""Shared folders and connected components for the corpus operators."""

from __future__ import annotations

import atexit
import gc
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that divides words, as a character class of Java and DuckDB patterns.
SPACE = "[\\x20\\x09-\\x0D]+"
UPPER_ASCII = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_SPILLED: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    have = spark.sparkContext.getCheckpointDir()
    if have is None:
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        have = spark.sparkContext.getCheckpointDir()
    return have


def spill(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and returns the written table.

    Cuts the lineage, so that a lost executor costs no more than a reread.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tidemark-{name}-{uuid.uuid4().hex}"
    _SPILLED.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing holds any more.

    It does so when the driver's JVM collects its garbage, which by itself may
    take half an hour; between the large steps of an operator that is too late.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@atexit.register
def _sweep() -> None:
    for spark, path in _SPILLED:
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended: its folder is swept by whoever owns it
            return


def words(text, pattern: str = SPACE):
    """The words of a text column; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), pattern), "")


def let(value, body):
    """``body`` of ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def connected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components: (node, component), the component being its smallest node.

    Alternates large and small stars on the edges until nothing changes; every
    round is a shuffle on the node and is written to the shared folder.  Nodes
    without an edge do not appear.
    """
    now = spill(
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct(),
        "edges",
    )
    print_of = F.struct(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s"))
    before = now.agg(print_of.alias("p")).first()["p"]
    while True:
        # large star: every larger neighbour of a node hangs from the least node around it
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        now = spill(
            both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large"
        )
        # small star: a node and its smaller neighbours hang from the least of them
        least = now.groupBy("u").agg(F.min("v").alias("m"))
        joined = now.join(least, "u")
        now = spill(
            joined.where("v != m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v")))
            .distinct(),
            "small",
        )
        after = now.agg(print_of.alias("p")).first()["p"]
        if after == before:
            break
        before = after
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


#: Rows of keys that may be broadcast; beyond it the same join is shuffled.
BROADCAST_ROWS = 1 << 20


def small(keys: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``keys`` (narrow, already written) with a broadcast hint if it has at most ``rows`` rows."""
    return F.broadcast(keys) if keys.count() <= rows else keys


def discard(table: DataFrame) -> None:
    """Deletes a spilled table that nothing reads any more."""
    spark = table.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
