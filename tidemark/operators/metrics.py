"""Latency and throughput statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latency_stats(samples: DataFrame, elapsed_s: float, ceiling_us: int = 60_000_000) -> DataFrame:
    """By operation: outcomes, mean, rate and nearest-rank percentiles of successes, clamped to [1, ceiling].

    ``samples`` has op, outcome, elapsed_us.  Counts by value come first, so that
    percentiles are exact and need no list of all samples.
    """
    us = F.greatest(F.lit(1), F.least(F.lit(ceiling_us), "elapsed_us")).cast("long")
    by = samples.groupBy("op", "outcome", us.alias("us")).agg(F.count("*").alias("n"))
    out = by.groupBy("op").agg(
        *[F.coalesce(F.sum(F.when(F.col("outcome") == o, F.col("n"))), F.lit(0)).alias(o.lower()) for o in ("Success", "Error", "Timeout", "Miss")],
        F.sum(F.when(F.col("outcome") == "Success", F.col("n") * F.col("us"))).alias("total_us"),
    )
    run = Window.partitionBy("op").orderBy("us")
    ok = by.where("outcome = 'Success'").withColumns({"upto": F.sum("n").over(run), "all": F.sum("n").over(Window.partitionBy("op"))})
    marks = ok.groupBy("op").agg(*[F.min(F.when(F.col("upto") >= F.ceil(F.col("all") * q / 1000), F.col("us"))).alias(f"p{str(q / 10).rstrip('0').rstrip('.').replace('.', '_')}_us") for q in (500, 990, 999)])
    return out.join(marks, "op", "left").withColumn("mean_us", F.col("total_us") / F.col("success")).withColumn("rps", F.col("success") / F.lit(elapsed_s)).drop("total_us")


def merge_partials(partials: DataFrame) -> DataFrame:
    """Sums of workers' partial statistics: (op, n, total_us, most_us)."""
    return partials.groupBy("op").agg(F.sum("n").alias("n"), F.sum("total_us").alias("total_us"), F.max("most_us").alias("most_us"))


def rolling_p99(samples: DataFrame, key: str = "op", size: int = 512) -> DataFrame:
    """The nearest-rank 99th percentile of each row's last ``size`` samples."""
    w = Window.partitionBy(key).orderBy("ts_l", "seq").rowsBetween(-(size - 1), 0)
    held = F.sort_array(F.collect_list("elapsed_us").over(w))
    return samples.select(key, "seq", held.alias("h")).select(key, "seq", F.element_at("h", F.ceil(F.size("h") * F.lit(99) / 100).cast("int")).alias("p99_us"))
