"""Deterministic encodings of the driver's tables as revision logs and operation logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket_of(key):
    """All before the last slash; null without one."""
    return F.when(F.contains(key, F.lit("/")), F.regexp_replace(key, "/[^/]*$", ""))


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One key for each user, one revision for each event; errors are tombstones, sign-ups expire."""
    return table(spark, sf_dir, "events").selectExpr(
        "concat('users/', lpad(cast(user_id as string), 6, '0')) as key",
        "'users' as bucket",
        "cast(row_number() over (partition by user_id order by ts, event_id) - 1 as bigint) as revision",
        "case when event_type <> 'error' then event_type end as value",
        "timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts) as ts_l",
        "case when event_type = 'signup' then timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts) + cast(floor(value) as bigint) * 3600000 end as expires_l",
        "case when event_type = 'error' then 'Deleted' else 'Set' end as state",
        "false as no_revision",
    )


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One key for each order, in a bucket for its priority."""
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('orders/', o_orderpriority, '/', lpad(cast(o_orderkey as string), 9, '0')) as key",
        "concat('orders/', o_orderpriority) as bucket",
        "cast(0 as bigint) as revision",
        "o_orderstatus as value",
        "timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', o_orderdate) as ts_l",
        "cast(null as bigint) as expires_l",
        "case when o_orderstatus = 'P' then 'Deleted' else 'Set' end as state",
        "false as no_revision",
    )


def events_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """click sets if present, signup if absent, purchase with a lifetime, view if unchanged, error deletes."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id as seq",
        "case when event_type = 'error' then 'DELETE' when event_type = 'view' and event_id % 3 = 0 then 'EXTEND' else 'SET' end as op",
        "concat('users/', lpad(cast(user_id as string), 6, '0')) as key",
        "event_type as value",
        "event_type = 'signup' as nx",
        "event_type = 'click' as xx",
        "case when event_type = 'view' and event_id % 3 = 1 then 'click' end as cmp_value",
        "case when event_type = 'view' and event_id % 3 = 2 then event_id % 7 end as cmp_rev",
        "event_id % 11 = 0 as norev",
        "case when event_type = 'purchase' then cast(floor(value) as bigint) * 60000 when event_type = 'view' and event_id % 3 = 0 then 3600000 else 0 end as ttl_ms",
        "timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts) as ts_l",
    )


def events_locks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users contend for one lock for each event type and hour of the day."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id as seq",
        "case event_type when 'error' then 'unlock' when 'view' then 'extend' when 'purchase' then 'get' else 'lock' end as op",
        "concat('lock/', cast(user_id % 7 as string)) as resource",
        "cast(user_id % 3 as string) as owner",
        "cast(floor(value) as bigint) * 1000 as ttl_ms",
        "timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts) as ts_l",
    )


def lineitem_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey * 10 + l_linenumber as seq",
        "l_returnflag as name",
        "cast(l_linenumber as bigint) as count",
        "case when l_orderkey % 5 = 0 then cast(l_orderkey as string) end as idempotency_key",
        "timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', l_shipdate) as ts_l",
    )


def lineitem_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read sets: an order reads its parts, at a revision it once saw."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey as txn_id",
        "concat('users/', lpad(cast(l_suppkey % 200 as string), 6, '0')) as key",
        "l_linenumber % 4 <> 0 as existed",
        "cast(l_linenumber as bigint) as revision",
    ).distinct()


def lineitem_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One prepared intent for each user key, from the lines of orders."""
    return table(spark, sf_dir, "lineitem").groupBy(F.expr("concat('users/', lpad(cast(l_partkey % 300 as string), 6, '0'))").alias("key")).agg(
        F.max("l_orderkey").alias("txn_id")
    ).selectExpr(
        "key",
        "txn_id",
        "1704067200000 + txn_id * 1000 as commit_l",
        "case txn_id % 4 when 0 then 'Aborted' when 1 then 'Pending' else 'Committed' end as resolution",
        "case when txn_id % 5 = 0 then 'Deleted' else 'Set' end as state",
        "concat('v', cast(txn_id as string)) as value",
        "cast(1000 as bigint) as revision",
        "cast(null as bigint) as expires_l",
    )


def order_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range locks of orders on user keys: start, end, bounds and mode by the order's key."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as txn_id",
        "concat('space/', cast(o_custkey div 10 as string)) as bucket",
        "case when o_orderkey % 61 <> 0 then lpad(cast(o_orderkey % 1000 as string), 6, '0') end as start_key",
        "o_orderkey % 2 = 0 as start_incl",
        "case when o_orderkey % 101 <> 0 then lpad(cast(o_orderkey % 1000 + o_orderkey % 30 + 1 as string), 6, '0') end as end_key",
        "o_orderkey % 4 = 0 as end_incl",
        "case when o_orderkey % 3 = 0 then 'X' else 'S' end as mode",
        "timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', o_orderdate) as expires_l",
    )


def lineitem_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write sets: an order writes the keys of its returned lines, in the buckets of the range locks."""
    return table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").selectExpr(
        "l_orderkey as txn_id",
        "concat('space/', cast(l_suppkey % 100 as string)) as bucket",
        "lpad(cast(l_partkey % 1000 as string), 6, '0') as key",
    ).distinct()


def order_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range map over order keys: one key space for each priority, cut at every 2,000th order."""
    cuts = table(spark, sf_dir, "orders").where("o_orderkey % 2000 = 0").selectExpr(
        "concat('orders/', o_orderpriority) as key_space",
        "concat('orders/', o_orderpriority, '/', lpad(cast(o_orderkey as string), 9, '0')) as cut",
    )
    starts = cuts.union(table(spark, sf_dir, "orders").selectExpr("concat('orders/', o_orderpriority)", "cast(null as string)").distinct())
    return starts.selectExpr(
        "key_space",
        "cut as start_key",
        "lead(cut) over (partition by key_space order by cut nulls first) as end_key",
        "cast(row_number() over (partition by key_space order by cut nulls first) as int) as partition_id",
        "cast(1 as bigint) as generation",
    )
