"""Reading and writing logs: Parquet for tables, JSON lines for segments, streams of either."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas


def write_log(log: DataFrame, path: str, shards: int = 16) -> None:
    """Appends revisions, clustered so that key bounds and shards prune files on reading."""
    sharded = log.withColumn("shard", F.pmod(F.xxhash64("bucket"), F.lit(shards)).cast("int"))
    spread = sharded.repartitionByRange("shard", "key").sortWithinPartitions("shard", "key", "revision")
    spread.write.mode("append").partitionBy("shard").parquet(path)


def read_log(spark: SparkSession, path: str, bucket: str | None = None, shards: int = 16) -> DataFrame:
    """The log; with a bucket, only that bucket's shard."""
    log = spark.read.parquet(path)
    if bucket is not None:
        shard = spark.range(1).select(F.pmod(F.xxhash64(F.lit(bucket)), F.lit(shards)).cast("int")).first()[0]
        log = log.where((F.col("shard") == shard) & (F.col("bucket") == bucket))
    return log.drop("shard")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df``, written to the folder that the cluster shares, so that what follows does not compute it again."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:  # a single machine, as in tests
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        folder = spark.sparkContext.getCheckpointDir()
    path = f"{folder.rstrip('/')}/tidemark-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def upsert(log: DataFrame, more: DataFrame) -> DataFrame:
    """The rows of ``more`` replace those of ``log`` with their key and revision."""
    both = log.withColumn("__n", F.lit(0)).unionByName(more.withColumn("__n", F.lit(1)))
    last = Window.partitionBy("key", "revision").orderBy(F.desc("__n"), F.desc("ts_l"))
    return both.withColumn("__r", F.row_number().over(last)).where("__r = 1").drop("__r", "__n")


def norev_spans(mutations: DataFrame) -> DataFrame:
    """The first and last time of unarchived writes, by key."""
    return mutations.where("norev and op = 'SET'").groupBy("key").agg(F.min("ts_l").alias("earliest_l"), F.max("ts_l").alias("latest_l"))


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.REVISION_LOG).json(path)


def stream_mutations(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(schemas.MUTATIONS).parquet(path)


def memory_log(spark: SparkSession, rows: list) -> DataFrame:
    return spark.createDataFrame(rows, schemas.REVISION_LOG)
