"""The engine's operators as queries over the driver's tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.columns import Typed, compile_expression, text as column_text
from .operators import folds, metrics, ranges, reads, retention, scans, visibility
from .plans import scripts
from .sources import encodings as enc
from .sources import storage

T = 1705276800000  # 2024-01-15 00:00 UTC
NOW = 1705881600000  # a week later
HOUR = 3600000
ROW = ("key", "revision", "value", "ts_l")

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: The encodings of sources.encodings in SQL.
_MS = {"events": "(epoch_us(ts) // 1000)", "orders": "(epoch_us(o_orderdate) // 1000)", "lineitem": "(epoch_us(l_shipdate) // 1000)"}
_WITH = {
    "L": f"""L AS (SELECT 'users/' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS key, 'users' AS bucket,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS revision, CASE WHEN event_type <> 'error' THEN event_type END AS value,
  {_MS['events']} AS ts_l, CASE WHEN event_type = 'signup' THEN {_MS['events']} + CAST(floor(value) AS BIGINT) * 3600000 END AS expires_l,
  CASE WHEN event_type = 'error' THEN 'Deleted' ELSE 'Set' END AS state FROM events)""",
    "O": f"""O AS (SELECT 'orders/' || o_orderpriority || '/' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS key, 'orders/' || o_orderpriority AS bucket,
  CAST(0 AS BIGINT) AS revision, o_orderstatus AS value, {_MS['orders']} AS ts_l, CAST(NULL AS BIGINT) AS expires_l,
  CASE WHEN o_orderstatus = 'P' THEN 'Deleted' ELSE 'Set' END AS state FROM orders)""",
    "I": """I AS (SELECT key, txn_id, 1704067200000 + txn_id * 1000 AS commit_l,
  CASE txn_id % 4 WHEN 0 THEN 'Aborted' WHEN 1 THEN 'Pending' ELSE 'Committed' END AS resolution,
  CASE WHEN txn_id % 5 = 0 THEN 'Deleted' ELSE 'Set' END AS state, 'v' || CAST(txn_id AS VARCHAR) AS value, CAST(1000 AS BIGINT) AS revision
  FROM (SELECT 'users/' || lpad(CAST(l_partkey % 300 AS VARCHAR), 6, '0') AS key, max(l_orderkey) AS txn_id FROM lineitem GROUP BY 1))""",
    "X": """X AS (SELECT DISTINCT l_orderkey AS txn_id, 'users/' || lpad(CAST(l_suppkey % 200 AS VARCHAR), 6, '0') AS key, l_linenumber % 4 <> 0 AS existed,
  CAST(l_linenumber AS BIGINT) AS revision FROM lineitem)""",
    "K": f"""K AS (SELECT o_orderkey AS txn_id, 'space/' || CAST(o_custkey // 10 AS VARCHAR) AS bucket,
  CASE WHEN o_orderkey % 61 <> 0 THEN lpad(CAST(o_orderkey % 1000 AS VARCHAR), 6, '0') END AS start_key, o_orderkey % 2 = 0 AS start_incl,
  CASE WHEN o_orderkey % 101 <> 0 THEN lpad(CAST(o_orderkey % 1000 + o_orderkey % 30 + 1 AS VARCHAR), 6, '0') END AS end_key, o_orderkey % 4 = 0 AS end_incl,
  CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE 'S' END AS mode, {_MS['orders']} AS expires_l FROM orders)""",
    "M": """M AS (SELECT key_space, cut AS start_key, lead(cut) OVER (PARTITION BY key_space ORDER BY cut NULLS FIRST) AS end_key,
  CAST(row_number() OVER (PARTITION BY key_space ORDER BY cut NULLS FIRST) AS INT) AS partition_id, CAST(1 AS BIGINT) AS generation
  FROM (SELECT 'orders/' || o_orderpriority AS key_space, 'orders/' || o_orderpriority || '/' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS cut
        FROM orders WHERE o_orderkey % 2000 = 0 UNION ALL SELECT DISTINCT 'orders/' || o_orderpriority, NULL FROM orders))""",
}


def _query(name: str, sql: str | None = None, uses: str = ""):
    """Registers a query; ``uses`` names the encodings that its SQL reads."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = ("WITH " + ",\n".join(_WITH[u] for u in uses) + "\n" if uses else "") + sql
        return f

    return add


_NEWEST = "SELECT * FROM {0} QUALIFY row_number() OVER (PARTITION BY key ORDER BY revision DESC, ts_l DESC) = 1"
_LIVE = f"state = 'Set' AND (expires_l IS NULL OR expires_l >= {NOW})"
_HEAD = f"(SELECT * FROM ({_NEWEST.format('L')}) WHERE {_LIVE})"
_ASOF = f"(SELECT * FROM ({_NEWEST.format(f'(SELECT * FROM L WHERE ts_l <= {T})')}) WHERE {_LIVE})"


@_query("kv_latest", f"SELECT key, revision, value, ts_l FROM {_HEAD}", "L")
def kv_latest(spark: SparkSession, d: str) -> DataFrame:
    return reads.latest(enc.events_log(spark, d), NOW).select(*ROW)


@_query("kv_as_of", f"SELECT key, revision, value, ts_l FROM {_ASOF}", "L")
def kv_as_of(spark, d):
    return reads.as_of(enc.events_log(spark, d), T, NOW).select(*ROW)


@_query("kv_as_of_max_revision", f"SELECT key, revision, value, ts_l FROM ({_NEWEST.format(f'(SELECT * FROM L WHERE ts_l <= {T} AND revision <= 3)')}) WHERE {_LIVE}", "L")
def kv_as_of_max_revision(spark, d):
    return reads.as_of(enc.events_log(spark, d), T, NOW, max_revision=3).select(*ROW)


@_query("kv_by_revision", "SELECT key, revision, value, ts_l FROM L WHERE revision = 3", "L")
def kv_by_revision(spark, d):
    return reads.by_revision(enc.events_log(spark, d), 3).select(*ROW)


_ASKED = "(SELECT 'users/' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS key, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 5 END AS asked FROM customer)"


def _asked(spark, d):
    return enc.table(spark, d, "customer").selectExpr(
        "concat('users/', lpad(cast(c_custkey as string), 6, '0')) as key", "case when c_custkey % 2 = 0 then c_custkey % 5 end as revision"
    )


@_query(
    "kv_get_many",
    f"""SELECT a.key, a.asked, coalesce(h.revision, e.revision) AS revision, coalesce(h.value, e.value) AS value, coalesce(h.revision, e.revision) IS NOT NULL AS found
FROM {_ASKED} a LEFT JOIN {_HEAD} h ON a.asked IS NULL AND a.key = h.key LEFT JOIN L e ON a.asked IS NOT NULL AND a.key = e.key AND a.asked = e.revision""",
    "L",
)
def kv_get_many(spark, d):
    return reads.get_many(enc.events_log(spark, d), _asked(spark, d), NOW)


@_query("kv_exists_many", f"SELECT a.key, h.key IS NOT NULL AS found, coalesce(h.revision, -1) AS revision FROM {_ASKED} a LEFT JOIN {_HEAD} h USING (key)", "L")
def kv_exists_many(spark, d):
    return reads.exists(enc.events_log(spark, d), _asked(spark, d), now_l=NOW)


@_query("kv_exists_at_rev", f"SELECT a.key, CAST(a.asked AS BIGINT) AS revision, l.key IS NOT NULL AS found FROM {_ASKED} a LEFT JOIN L l ON a.key = l.key AND a.asked = l.revision WHERE asked IS NOT NULL", "L")
def kv_exists_at_rev(spark, d):
    return reads.exists_at(enc.events_log(spark, d), _asked(spark, d).where("revision is not null"))


@_query("kv_exists_as_of", f"SELECT a.key, h.key IS NOT NULL AS found, coalesce(h.revision, -1) AS revision FROM {_ASKED} a LEFT JOIN {_ASOF} h USING (key)", "L")
def kv_exists_as_of(spark, d):
    return reads.exists(enc.events_log(spark, d), _asked(spark, d), T, NOW)


@_query("read_own_writes", f"SELECT key, revision, value, state FROM {_HEAD} h WHERE key NOT IN (SELECT key FROM I) UNION ALL SELECT key, revision, value, state FROM I WHERE state = 'Set'", "LI")
def read_own_writes(spark, d):
    return reads.overlay_own(reads.latest(enc.events_log(spark, d), NOW), enc.lineitem_intents(spark, d))


_OL = "(SELECT * FROM O WHERE state = 'Set')"


@_query("scan_bucket", f"SELECT key, revision, value, ts_l FROM {_OL} WHERE starts_with(key, 'orders/1') ORDER BY key LIMIT 4096", "O")
def scan_bucket(spark, d):
    return scans.by_bucket(enc.orders_log(spark, d), "orders/1", now_l=NOW).select(*ROW)


@_query("scan_bucket_exact", f"SELECT key, revision, value, ts_l FROM {_OL} WHERE bucket = 'orders/2-HIGH'", "O")
def scan_bucket_exact(spark, d):
    return scans.by_bucket(enc.orders_log(spark, d), "orders/2-HIGH", exact=True, limit=None, now_l=NOW).select(*ROW)


@_query(
    "scan_prefix_newest_wins",
    f"SELECT key, revision, value, ts_l FROM ({_NEWEST.format('L')}) WHERE starts_with(key, 'users/0000') AND {_LIVE}",
    "L",
)
def scan_prefix_newest_wins(spark, d):
    log = enc.events_log(spark, d)
    return scans.by_prefix([log.where("revision % 2 = 0"), log.where("revision % 3 = 0"), log.where("revision % 2 = 1")], "users/0000", now_l=NOW).select(*ROW)


@_query("scan_tombstones", f"SELECT key, revision, value, ts_l, state FROM ({_NEWEST.format('L')}) WHERE state = 'Deleted' OR ({_LIVE})", "L")
def scan_tombstones(spark, d):
    return scans.by_prefix([enc.events_log(spark, d)], "users/", tombstones=True, now_l=NOW).select(*ROW, "state")


for _name, _lo, _hi in (("incl_incl", True, True), ("incl_excl", True, False), ("excl_incl", False, True), ("excl_excl", False, False)):
    _sql = f"SELECT key, revision, value, ts_l FROM {_HEAD} WHERE key >{'=' * _lo} 'users/000010' AND key <{'=' * _hi} 'users/000060'"

    def _range(spark, d, lo=_lo, hi=_hi):
        return scans.by_range(enc.events_log(spark, d), "users/", "users/000010", lo, "users/000060", hi, now_l=NOW).select(*ROW)

    _query(f"scan_range_{_name}", _sql, "L")(_range)


@_query("scan_page", f"SELECT key, revision, value, ts_l FROM {_OL} WHERE starts_with(key, 'orders/') ORDER BY key LIMIT 50", "O")
def scan_page(spark, d):
    return scans.by_range(enc.orders_log(spark, d), "orders/", limit=50, now_l=NOW).select(*ROW)


@_query(
    "scan_cursor_resume",
    f"SELECT key, revision, value, ts_l FROM {_OL} WHERE starts_with(key, 'orders/') AND ts_l <= {T} ORDER BY key LIMIT 25 OFFSET 25",
    "O",
)
def scan_cursor_resume(spark, d):
    log = enc.orders_log(spark, d)
    _, _, cursor = scans.page(log, 25, "orders/", as_of_l=T, now_l=NOW)
    last, prefix, _, as_of_l = scans.decode_cursor(cursor)
    return scans.by_range(log, prefix, last, False, limit=25, as_of_l=as_of_l, now_l=NOW).select(*ROW)


@_query("scan_as_of", f"SELECT key, revision, value, ts_l FROM {_ASOF} WHERE key >= 'users/000020'", "L")
def scan_as_of(spark, d):
    return scans.by_range(enc.events_log(spark, d), "users/", "users/000020", as_of_l=T, now_l=NOW).select(*ROW)


@_query("overlay_unflushed", f"SELECT key, revision, value, ts_l, state FROM ({_NEWEST.format('L')})", "L")
def overlay_unflushed(spark, d):
    log = enc.events_log(spark, d)
    return scans.overlay(log.where(f"ts_l <= {T}"), log.where(f"ts_l > {T}")).select(*ROW, "state")


@_query("trim_history", "SELECT key, revision FROM L QUALIFY row_number() OVER (PARTITION BY key ORDER BY revision DESC) <= 16 OR revision = max(CASE WHEN ts_l <= %d THEN revision END) OVER (PARTITION BY key)" % T, "L")
def trim_history(spark, d):
    return retention.trim(enc.events_log(spark, d), 16, T).select("key", "revision")


_RANK = "row_number() OVER (PARTITION BY key ORDER BY revision DESC) AS n, max(CASE WHEN ts_l <= %d THEN revision END) OVER (PARTITION BY key) AS f" % T


@_query("prune_count", f"SELECT key, revision FROM (SELECT *, {_RANK} FROM L) WHERE n > 5", "L")
def prune_count(spark, d):
    return retention.prunable(enc.events_log(spark, d), keep=5).select("key", "revision")


@_query("prune_age", f"SELECT key, revision FROM (SELECT *, {_RANK} FROM L) WHERE ts_l < {T} AND n > 1", "L")
def prune_age(spark, d):
    return retention.prunable(enc.events_log(spark, d), older_l=T).select("key", "revision")


_PRUNED = f"(SELECT key, revision FROM (SELECT *, {_RANK} FROM L) WHERE n > 5 AND revision < coalesce(f, -1))"


@_query("prune_floor", f"SELECT key, revision FROM {_PRUNED}", "L")
def prune_floor(spark, d):
    return retention.prunable(enc.events_log(spark, d), keep=5, floor_l=T).select("key", "revision")


@_query(
    "pruned_history_floor",
    f"SELECT max(o) AS floor_l FROM (SELECT key, min(ts_l) AS o FROM L WHERE (key, revision) NOT IN (SELECT (key, revision) FROM {_PRUNED}) AND key IN (SELECT key FROM {_PRUNED}) GROUP BY key)",
    "L",
)
def pruned_history_floor(spark, d):
    log = enc.events_log(spark, d)
    return retention.pruned_history_floor(log, retention.prunable(log, keep=5, floor_l=T))


@_query("effective_floor", f"SELECT min((epoch_us(ts) // 1000)) AS floor_l FROM events WHERE event_type = 'view' AND (epoch_us(ts) // 1000) + CAST(floor(value) AS BIGINT) * {HOUR} >= {T}")
def effective_floor(spark, d):
    holds = enc.events_log(spark, d).where("value = 'view'").select("ts_l").join(
        enc.table(spark, d, "events").where("event_type = 'view'").selectExpr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts) as ts_l", "value as v"), "ts_l"
    )
    return retention.effective_floor(holds.selectExpr("ts_l", f"ts_l + cast(floor(v) as bigint) * {HOUR} as lease_l"), T)


@_query("checkpoint_as_of", f"SELECT key, revision, value, ts_l, state FROM ({_NEWEST.format(f'(SELECT * FROM L WHERE ts_l <= {T})')})", "L")
def checkpoint_as_of(spark, d):
    return retention.checkpoint(enc.events_log(spark, d), T).select(*ROW, "state")


@_query("restore_to", f"SELECT key, revision, value, ts_l, state FROM L WHERE ts_l <= {T}", "L")
def restore_to(spark, d):
    log = enc.events_log(spark, d)
    return retention.restore(log.where(f"ts_l <= {T - 5 * 24 * HOUR}"), log.where(f"ts_l > {T - 7 * 24 * HOUR}"), T).select(*ROW, "state")


@_query(
    "incremental_backup",
    "SELECT e.event_id AS idx, e.user_id % 8 AS part FROM events e LEFT JOIN (SELECT user_id % 8 AS p, max(event_id) AS high FROM events WHERE user_id % 8 < 6 AND event_id % 2 = 0 AND event_id < 5000 GROUP BY 1) m ON e.user_id % 8 = p WHERE event_id > coalesce(high, 0)",
)
def incremental_backup(spark, d):
    ev = enc.table(spark, d, "events").selectExpr("event_id as idx", "user_id % 8 as part")
    marks = ev.where("part < 6 and idx % 2 = 0 and idx < 5000").groupBy("part").agg(F.max("idx").alias("high"))
    return retention.incremental(ev, marks).select("idx", "part")


@_query("log_index_at", f"SELECT min(CASE WHEN (epoch_us(ts) // 1000) >= {T} THEN event_id END) AS first_at_or_after, max(CASE WHEN (epoch_us(ts) // 1000) <= {T} THEN event_id END) AS last_at_or_before FROM events")
def log_index_at(spark, d):
    return retention.index_at(enc.events_mutations(spark, d).withColumnRenamed("seq", "idx"), T)


@_query("safe_snapshot_time", "SELECT coalesce((SELECT min(commit_l) FROM I WHERE resolution = 'Pending') - 1, (SELECT max(commit_l) FROM I WHERE resolution = 'Committed')) AS safe_l", "I")
def safe_snapshot_time(spark, d):
    i = enc.lineitem_intents(spark, d)
    return retention.safe_time(i.where("resolution = 'Pending'"), i.where("resolution = 'Committed'"))


_MAN = "(SELECT o_orderkey AS backup_id, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey - 1 END AS parent_id, CASE WHEN o_orderkey % 7 <> 0 THEN 'incremental' ELSE 'full' END AS type, o_orderkey * 10 AS first_index, o_orderkey * 10 + 9 + o_orderkey % 3 // 2 AS last_index FROM orders)"


def _manifests(spark, d):
    return enc.table(spark, d, "orders").selectExpr(
        "o_orderkey as backup_id", "case when o_orderkey % 7 <> 0 then o_orderkey - 1 end as parent_id", "case when o_orderkey % 7 <> 0 then 'incremental' else 'full' end as type",
        "o_orderkey * 10 as first_index", "o_orderkey * 10 + 9 + (o_orderkey % 3) div 2 as last_index",
    )


@_query(
    "backup_chains",
    f"""WITH RECURSIVE m AS {_MAN}, up(leaf_id, backup_id, parent_id, depth) AS (SELECT backup_id, backup_id, parent_id, 0 FROM m WHERE backup_id NOT IN (SELECT parent_id FROM m WHERE parent_id IS NOT NULL)
UNION ALL SELECT up.leaf_id, m.backup_id, m.parent_id, up.depth + 1 FROM up JOIN m ON m.backup_id = up.parent_id) SELECT leaf_id, backup_id, depth FROM up""",
)
def backup_chains(spark, d):
    return retention.chains(spark, _manifests(spark, d))


@_query(
    "broken_chains",
    f"""WITH m AS {_MAN} SELECT m.backup_id, CASE WHEN m.type = 'full' AND m.parent_id IS NOT NULL THEN 'full with a parent' WHEN m.type = 'incremental' AND p.backup_id IS NULL THEN 'parent missing'
WHEN m.type = 'incremental' AND m.first_index <> p.last_index + 1 THEN 'range does not follow' END AS problem FROM m LEFT JOIN m p ON m.parent_id = p.backup_id WHERE problem IS NOT NULL""",
)
def broken_chains(spark, d):
    return retention.broken_chains(_manifests(spark, d))


@_query("orphans", f"WITH m AS {_MAN} SELECT c_custkey * 13 AS backup_id FROM customer WHERE c_custkey * 13 NOT IN (SELECT backup_id FROM m)")
def orphans(spark, d):
    return retention.orphans(enc.table(spark, d, "customer").selectExpr("c_custkey * 13 as backup_id"), _manifests(spark, d))


@_query("route_range", "SELECT O.key, O.bucket AS key_space, partition_id, generation FROM O LEFT JOIN M ON O.bucket = M.key_space AND (start_key IS NULL OR key >= start_key) AND (end_key IS NULL OR key < end_key)", "OM")
def route_range(spark, d):
    return ranges.route_range(enc.orders_log(spark, d), enc.order_map(spark, d))


@_query("route_hash_colocation", "SELECT bucket, count(*) AS keys, CAST(1 AS BIGINT) AS partitions FROM O GROUP BY bucket", "O")
def route_hash_colocation(spark, d):
    routed = ranges.route_hash(enc.orders_log(spark, d), 8)
    return routed.groupBy("bucket").agg(F.count("*").alias("keys"), F.count_distinct("partition_id").alias("partitions"))


_LO, _HI = "orders/3-MEDIUM/000001000", "orders/3-MEDIUM/000009000"


@_query(
    "intersecting",
    f"""SELECT key_space, partition_id, CASE WHEN start_key IS NULL OR start_key < '{_LO}' THEN '{_LO}' ELSE start_key END AS clip_start, CASE WHEN end_key IS NULL OR end_key > '{_HI}' THEN '{_HI}' ELSE end_key END AS clip_end
FROM M WHERE key_space = 'orders/3-MEDIUM' AND (start_key IS NULL OR start_key < '{_HI}') AND (end_key IS NULL OR end_key > '{_LO}')""",
    "M",
)
def intersecting(spark, d):
    return ranges.intersecting(enc.order_map(spark, d), "orders/3-MEDIUM", _LO, _HI)


@_query("map_validate", "SELECT key_space, start_key, 'gap' AS problem FROM (SELECT *, lead(partition_id) OVER (PARTITION BY key_space ORDER BY start_key NULLS FIRST) AS nxt FROM M) WHERE nxt = 2", "M")
def map_validate(spark, d):
    m = enc.order_map(spark, d)
    return ranges.validate_map(m.withColumn("end_key", F.when(F.col("partition_id") == 1, F.concat(F.col("key_space"), F.lit("/0"))).otherwise(F.col("end_key"))))


@_query(
    "split_median",
    """SELECT bucket, n, monotonic, key AS split_key FROM (SELECT *, n >= 100 AND n >= 20 AND i = greatest(10, least(CAST(round_even(n * CASE WHEN monotonic THEN 0.75 ELSE 0.5 END, 0) AS BIGINT), n - 10)) AS hit FROM (
SELECT *, sum(CASE WHEN ts_l >= bar AND i >= n - greatest(1, n // 4) THEN 1 ELSE 0 END) OVER (PARTITION BY bucket) * 4 >= sum(CASE WHEN ts_l >= bar THEN 1 ELSE 0 END) OVER (PARTITION BY bucket) * 3 AS monotonic FROM (
SELECT *, max(CASE WHEN age = greatest(1, n // 4) THEN ts_l END) OVER (PARTITION BY bucket) AS bar FROM (
SELECT bucket, key, ts_l, row_number() OVER (PARTITION BY bucket ORDER BY key) - 1 AS i, count(*) OVER (PARTITION BY bucket) AS n, row_number() OVER (PARTITION BY bucket ORDER BY ts_l DESC, key) AS age FROM O)))) WHERE hit""",
    "O",
)
def split_median(spark, d):
    return ranges.split_points(enc.orders_log(spark, d), 100, 10)


_W = "(SELECT bucket, key, count(*) AS writes FROM L GROUP BY bucket, key)"


@_query(
    "split_centroid",
    f"""SELECT bucket, key AS split_key, CAST(greatest(l, total - l) AS BIGINT) AS heavier, CAST(total AS BIGINT) AS total FROM (
SELECT bucket, key, row_number() OVER (PARTITION BY bucket ORDER BY key) - 1 AS i, count(*) OVER (PARTITION BY bucket) AS n, sum(writes) OVER (PARTITION BY bucket) AS total,
coalesce(sum(writes) OVER (PARTITION BY bucket ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l FROM {_W})
WHERE i >= 5 AND n - i >= 5 AND total >= n QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY abs(2 * l - total), i) = 1""",
    "L",
)
def split_centroid(spark, d):
    w = enc.events_log(spark, d).groupBy("bucket", "key").agg(F.count("*").alias("writes"))
    return ranges.centroid_splits(w, 5)


_SIZES = "(SELECT M.key_space, M.start_key, M.partition_id, count(O.key) AS keys FROM M LEFT JOIN O ON O.bucket = M.key_space AND (start_key IS NULL OR key >= start_key) AND (end_key IS NULL OR key < end_key) GROUP BY ALL)"


@_query("range_key_count", f"SELECT * FROM {_SIZES}", "OM")
def range_key_count(spark, d):
    return ranges.range_counts(enc.orders_log(spark, d), enc.order_map(spark, d))


@_query(
    "merge_candidates",
    f"""SELECT key_space, partition_id AS left_id, right_id FROM (SELECT *, row_number() OVER (PARTITION BY key_space, isl ORDER BY n) AS place, lead(partition_id) OVER (PARTITION BY key_space, isl ORDER BY n) AS right_id FROM (
SELECT *, n - row_number() OVER (PARTITION BY key_space, small ORDER BY n) AS isl FROM (SELECT *, row_number() OVER (PARTITION BY key_space ORDER BY start_key NULLS FIRST) AS n, keys < 2000 AS small FROM {_SIZES})) WHERE small)
WHERE place % 2 = 1 AND right_id IS NOT NULL""",
    "OM",
)
def merge_candidates(spark, d):
    return ranges.merge_candidates(ranges.range_counts(enc.orders_log(spark, d), enc.order_map(spark, d)), 2000)


@_query("heavy_hitters", "SELECT key, count(*) AS n FROM L GROUP BY key ORDER BY n DESC, key LIMIT 20", "L")
def heavy_hitters(spark, d):
    return ranges.heavy_hitters(enc.events_log(spark, d), 20)


@_query("decay", "SELECT key, count(*) >> 3 AS n FROM L GROUP BY key HAVING count(*) >> 3 > 0", "L")
def decay(spark, d):
    return ranges.decay(enc.events_log(spark, d).groupBy("key").agg(F.count("*").alias("n")), 3)


@_query(
    "load_gate",
    f"""SELECT CAST(user_id % 10 AS VARCHAR) AS bucket, event_id AS seq, min(CASE WHEN value >= 1 AND event_id % 100 >= 1 THEN 1 ELSE 0 END) OVER w = 1 AND (epoch_us(ts) // 1000) - min((epoch_us(ts) // 1000)) OVER (PARTITION BY user_id % 10) >= {HOUR} AS open
FROM events WINDOW w AS (PARTITION BY user_id % 10 ORDER BY (epoch_us(ts) // 1000) RANGE BETWEEN {HOUR} PRECEDING AND CURRENT ROW)""",
)
def load_gate(spark, d):
    ev = enc.table(spark, d, "events").selectExpr("cast(user_id % 10 as string) as bucket", "event_id as seq", "timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts) as ts_l", "value as rate", "event_id % 100 as queue")
    gate = ranges.load_gate(ev, 1, 1, HOUR).distinct()
    return ev.select("bucket", "seq", "ts_l").join(gate, ["bucket", "ts_l"]).select("bucket", "seq", "open")


_LAT = "(SELECT event_type AS op, CASE event_id % 20 WHEN 0 THEN 'Error' WHEN 1 THEN 'Timeout' WHEN 2 THEN 'Miss' ELSE 'Success' END AS outcome, CAST(floor(value * 1000) AS BIGINT) AS elapsed_us FROM events)"


def _samples(spark, d):
    return enc.table(spark, d, "events").selectExpr(
        "event_type as op", "case event_id % 20 when 0 then 'Error' when 1 then 'Timeout' when 2 then 'Miss' else 'Success' end as outcome", "cast(floor(value * 1000) as bigint) as elapsed_us"
    )


_OK = "FILTER (WHERE outcome = 'Success')"


@_query(
    "latency_stats",
    f"""SELECT op, count(*) {_OK} AS success, count(*) FILTER (WHERE outcome = 'Error') AS error, count(*) FILTER (WHERE outcome = 'Timeout') AS timeout, count(*) FILTER (WHERE outcome = 'Miss') AS miss,
CAST(list_sort(list(us) {_OK})[CAST(ceil(count(*) {_OK} * 0.5) AS BIGINT)] AS BIGINT) AS p50_us, CAST(list_sort(list(us) {_OK})[(count(*) {_OK} * 990 + 999) // 1000] AS BIGINT) AS p99_us,
CAST(list_sort(list(us) {_OK})[(count(*) {_OK} * 999 + 999) // 1000] AS BIGINT) AS p99_9_us
FROM (SELECT *, greatest(1, least(60000000, elapsed_us)) AS us FROM {_LAT}) GROUP BY op""",
)
def latency_stats(spark, d):
    return metrics.latency_stats(_samples(spark, d), 30.0).drop("mean_us", "rps")


@_query("merge_partials", f"SELECT op, count(*) AS n, CAST(sum(elapsed_us) AS BIGINT) AS total_us, max(elapsed_us) AS most_us FROM {_LAT} GROUP BY op")
def merge_partials(spark, d):
    parts = _samples(spark, d).groupBy("op", "outcome").agg(F.count("*").alias("n"), F.sum("elapsed_us").alias("total_us"), F.max("elapsed_us").alias("most_us"))
    return metrics.merge_partials(parts)


@_query(
    "rolling_p99",
    """SELECT op, seq, h[(len(h) * 99 + 99) // 100] AS p99_us FROM (SELECT event_type AS op, event_id AS seq, list_sort(list(CAST(floor(value * 1000) AS BIGINT)) OVER (PARTITION BY event_type ORDER BY (epoch_us(ts) // 1000), event_id ROWS BETWEEN 511 PRECEDING AND CURRENT ROW)) AS h FROM events)""",
)
def rolling_p99(spark, d):
    ev = enc.table(spark, d, "events").selectExpr("event_type as op", "event_id as seq", "timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts) as ts_l", "cast(floor(value * 1000) as bigint) as elapsed_us")
    return metrics.rolling_p99(ev)


@_query(
    "intent_visibility",
    f"""SELECT coalesce(p.key, i.key) AS key, CASE WHEN i.resolution = 'Pending' THEN 'MustRetry' ELSE 'Visible' END AS status,
CASE WHEN i.resolution = 'Committed' THEN i.value ELSE p.value END AS value, CASE WHEN i.resolution = 'Committed' THEN i.revision ELSE p.revision END AS revision
FROM {_HEAD} p FULL JOIN (SELECT * FROM I WHERE commit_l <= {T} AND resolution <> 'Aborted') i ON p.key = i.key WHERE NOT coalesce(i.resolution = 'Committed' AND i.state = 'Deleted', FALSE)""",
    "LI",
)
def intent_visibility(spark, d):
    return visibility.intent_view(reads.latest(enc.events_log(spark, d), NOW), enc.lineitem_intents(spark, d), T)


@_query(
    "read_validation",
    f"""SELECT txn_id, conflicts, conflicts > 0 AS aborted FROM (SELECT x.txn_id, count(*) FILTER (WHERE existed <> (h.key IS NOT NULL) OR (existed AND coalesce(x.revision <> h.revision, TRUE))) AS conflicts
FROM X x LEFT JOIN {_HEAD} h USING (key) GROUP BY x.txn_id)""",
    "LX",
)
def read_validation(spark, d):
    return visibility.validate_reads(enc.lineitem_reads(spark, d), reads.latest(enc.events_log(spark, d), NOW))


@_query("early_conflicts", f"SELECT x.txn_id, x.key, x.revision, h.revision AS now_rev FROM X x JOIN {_HEAD} h USING (key) WHERE existed AND h.revision > x.revision", "LX")
def early_conflicts(spark, d):
    return visibility.early_conflicts(enc.lineitem_reads(spark, d), reads.latest(enc.events_log(spark, d), NOW))


_CUT = 820454400000  # in the middle of the orders


@_query(
    "lock_conflicts_sx",
    f"""SELECT a.bucket, a.txn_id AS txn_a, b.txn_id AS txn_b, a.mode || b.mode AS modes FROM K a JOIN K b ON a.bucket = b.bucket AND a.txn_id < b.txn_id AND (a.mode = 'X' OR b.mode = 'X')
AND (a.start_key IS NULL OR b.end_key IS NULL OR a.start_key < b.end_key OR (a.start_key = b.end_key AND a.start_incl AND b.end_incl))
AND (b.start_key IS NULL OR a.end_key IS NULL OR b.start_key < a.end_key OR (b.start_key = a.end_key AND b.start_incl AND a.end_incl))""",
    "K",
)
def lock_conflicts_sx(spark, d):
    return visibility.range_conflicts(enc.order_ranges(spark, d))


@_query(
    "keys_under_locks",
    f"""SELECT c.bucket, c.key, K.txn_id, K.mode FROM (SELECT 'space/' || CAST(c_custkey // 10 AS VARCHAR) AS bucket, lpad(CAST(c_custkey % 1000 AS VARCHAR), 6, '0') AS key FROM customer) c JOIN K ON c.bucket = K.bucket AND expires_l > {_CUT}
AND (start_key IS NULL OR c.key > start_key OR (start_incl AND c.key = start_key)) AND (end_key IS NULL OR c.key < end_key OR (end_incl AND c.key = end_key))""",
    "K",
)
def keys_under_locks(spark, d):
    keys = enc.table(spark, d, "customer").selectExpr("concat('space/', cast(c_custkey div 10 as string)) as bucket", "lpad(cast(c_custkey % 1000 as string), 6, '0') as key")
    return visibility.covered(keys, visibility.live_ranges(enc.order_ranges(spark, d), _CUT))


@_query(
    "commit_conflicts",
    f"""SELECT x.txn_id, x.key, 'intent' AS cause FROM X x JOIN I i ON x.key = i.key WHERE i.resolution = 'Pending' AND i.txn_id <> x.txn_id
UNION SELECT w.txn_id, w.key, 'range lock' FROM (SELECT l_orderkey AS txn_id, 'space/' || CAST(l_suppkey % 100 AS VARCHAR) AS bucket, lpad(CAST(l_partkey % 1000 AS VARCHAR), 6, '0') AS key FROM lineitem WHERE l_returnflag = 'R') w
JOIN K ON w.bucket = K.bucket AND w.txn_id <> K.txn_id AND expires_l > {_CUT} AND (start_key IS NULL OR w.key > start_key OR (start_incl AND w.key = start_key)) AND (end_key IS NULL OR w.key < end_key OR (end_incl AND w.key = end_key))""",
    "XIK",
)
def commit_conflicts(spark, d):
    locks = enc.order_ranges(spark, d)
    return visibility.commit_conflicts(enc.lineitem_reads(spark, d), enc.lineitem_writes(spark, d), enc.lineitem_intents(spark, d), locks, _CUT)


@_query(
    "txn_atomic_commit",
    "SELECT l_orderkey AS txn_id, count(*) AS keys, CASE WHEN bool_or(l_returnflag = 'A') AND bool_or(l_returnflag <> 'A') THEN 'Rejected' WHEN bool_and(l_quantity < 45) THEN 'Committed' ELSE 'Aborted' END AS decision FROM lineitem GROUP BY 1",
)
def txn_atomic_commit(spark, d):
    return visibility.commit_atomically(enc.table(spark, d, "lineitem").selectExpr("l_orderkey as txn_id", "case when l_returnflag = 'A' then 'E' else 'P' end as durability", "l_quantity < 45 as prepared"))


@_query(
    "priority_admission",
    f"SELECT seq, effective, row_number() OVER (ORDER BY effective DESC, seq) AS place FROM (SELECT event_id AS seq, CAST(least(greatest(3, user_id % 5), user_id % 5 + floor(({NOW} - (epoch_us(ts) // 1000)) / {24.0 * HOUR})) AS BIGINT) AS effective FROM events WHERE event_type = 'purchase' AND (epoch_us(ts) // 1000) <= {NOW})",
)
def priority_admission(spark, d):
    ev = enc.table(spark, d, "events").where("event_type = 'purchase'").selectExpr("event_id as seq", "user_id % 5 as priority", "timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts) as since_l")
    return visibility.priority_order(ev.where(F.col("since_l") <= NOW), NOW, 24 * HOUR)


def _env(spark, d) -> tuple[DataFrame, dict]:
    rows = enc.table(spark, d, "lineitem").selectExpr("l_orderkey as k", "l_linenumber as n", "cast(l_quantity as bigint) as q", "l_extendedprice as p", "l_returnflag as f", "cast(l_linenumber as string) as s")
    return rows, {"k": Typed("long", F.col("k")), "q": Typed("long", F.col("q")), "p": Typed("double", F.col("p")), "f": Typed("string", F.col("f")), "s": Typed("string", F.col("s"))}


_LI = "(SELECT l_orderkey AS k, l_linenumber AS n, CAST(l_quantity AS BIGINT) AS q, l_extendedprice AS p, l_returnflag AS f, CAST(l_linenumber AS VARCHAR) AS s FROM lineitem)"


def _expressions(name: str, pairs: dict[str, tuple[str, str]]) -> None:
    def run(spark, d):
        rows, env = _env(spark, d)
        return rows.select("k", "n", *[compile_expression(e, env, NOW).col.alias(c) for c, (e, _) in pairs.items()])

    _query(name, f"SELECT k, n, {', '.join(f'{sql} AS {c}' for c, (_, sql) in pairs.items())} FROM {_LI}")(run)


_expressions("expr_arith", {"a": ("q + k * 2 - 1", "q + k * 2 - 1"), "b": ("(q - 60) / 7", "(q - 60) // 7"), "c": ("s * 2 = q", "abs(CAST(s AS DOUBLE) * 2 - q) <= 0.001"), "e": ("to_int(p / 2 - 3)", "CAST(trunc(p / 2 - 3) AS BIGINT)")})
_expressions("expr_compare", {"a": ("q < 25", "q < 25"), "b": ("p >= q", "NOT p < q"), "c": ("f = 'A'", "f = 'A'"), "e": ("p = p + 0.0005", "TRUE"), "g": ("q <> 10", "q <> 10"), "h": ("s > 3", "CAST(s AS DOUBLE) > 3")})
_expressions("expr_logic", {"a": ("q > 10 && p > 20000.0", "q > 10 AND p > 20000.0"), "b": ("not (f = 'N') || q = 1", "NOT f = 'N' OR q = 1"), "c": ("!q", "q <> 0")})
_expressions("fn_math", {"a": ("abs(q - 25)", "abs(q - 25)"), "b": ("to_int(pow(q, 2))", "q * q"), "c": ("to_int(ceil(p))", "CAST(ceil(p) AS BIGINT)"), "e": ("to_int(floor(p))", "CAST(floor(p) AS BIGINT)"), "g": ("min(q, k)", "least(q, k)"), "h": ("max(q, k)", "greatest(q, k)"), "i": ("to_int(round(q / 2.0, 0))", "CAST(round_even(q / 2.0, 0) AS BIGINT)")})
_expressions("fn_cast", {"a": ("to_int(s) + 1", "CAST(s AS BIGINT) + 1"), "b": ("to_str(q)", "CAST(q AS VARCHAR)"), "c": ("to_bool(concat('tr', 'ue'))", "TRUE"), "e": ("to_bool(q - 1)", "q <> 1"), "g": ("to_str(q = 1)", "CASE WHEN q = 1 THEN 'true' ELSE 'false' END"), "h": ("to_int('')", "CAST(0 AS BIGINT)")})
_expressions("fn_string", {"a": ("concat(lower(f), s)", "lower(f) || s"), "b": ("upper(concat(f, 'x'))", "upper(f || 'x')"), "c": ("len(concat(f, to_str(q)))", "length(f || CAST(q AS VARCHAR))"), "e": ("to_json(f)", "'\"' || f || '\"'")})
_expressions("fn_array", {"a": ("count(1..q)", "q"), "b": ("(k..3)[2]", "k + 2"), "c": ("count(5..0)", "CAST(0 AS BIGINT)")})
_expressions("fn_meta", {"a": ("rev(q)", "CAST(-1 AS BIGINT)"), "b": ("expires(q)", "CAST(0 AS BIGINT)"), "c": ("current_time()", f"CAST({NOW} AS BIGINT)"), "e": ("is_int(q)", "TRUE"), "g": ("is_string(q)", "FALSE"), "h": ("is_null(f)", "FALSE")})


@_query("set_unconditional", f"SELECT key, event_id AS seq, row_number() OVER (PARTITION BY key ORDER BY ts_l, event_id) - 1 AS revision FROM (SELECT 'users/' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS key, event_id, (epoch_us(ts) // 1000) AS ts_l FROM events WHERE event_type = 'click')")
def set_unconditional(spark, d):
    ops = enc.events_mutations(spark, d).where("value = 'click'")
    plain = ops.withColumns({"op": F.lit("SET"), "nx": F.lit(False), "xx": F.lit(False), "cmp_value": F.lit(None).cast("string"), "cmp_rev": F.lit(None).cast("bigint"), "ttl_ms": F.lit(0)})
    return folds.apply_mutations(plain).select("key", "seq", "revision")


@_query("fold_set_nx", "SELECT key, event_id AS seq, CASE WHEN row_number() OVER (PARTITION BY key ORDER BY ts_l, event_id) = 1 THEN 'Set' ELSE 'NotSet' END AS status FROM (SELECT 'users/' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS key, event_id, (epoch_us(ts) // 1000) AS ts_l FROM events WHERE event_type = 'signup')")
def fold_set_nx(spark, d):
    return folds.apply_mutations(enc.events_mutations(spark, d).where("value = 'signup'")).select("key", "seq", "status")


@_query("fold_mutations")
def fold_mutations(spark, d):
    return folds.apply_mutations(enc.events_mutations(spark, d))


@_query("mutation_log")
def mutation_log(spark, d):
    ops = enc.events_mutations(spark, d)
    return folds.to_log(folds.apply_mutations(ops), ops)


@_query("lock_fencing")
def lock_fencing(spark, d):
    return folds.apply_leases(enc.events_locks(spark, d))


@_query("seq_next", "SELECT l_returnflag AS name, l_orderkey * 10 + l_linenumber AS seq, CAST(sum(l_linenumber) OVER (PARTITION BY l_returnflag ORDER BY l_orderkey * 10 + l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - l_linenumber + 1 AS BIGINT) AS first FROM lineitem")
def seq_next(spark, d):
    ops = enc.lineitem_requests(spark, d).withColumn("idempotency_key", F.lit(None).cast("string"))
    return folds.allocate(ops).select("name", "seq", "first")


@_query("seq_reserve_blocks")
def seq_reserve_blocks(spark, d):
    return folds.allocate(enc.lineitem_requests(spark, d).withColumn("idempotency_key", F.lit(None).cast("string")), block=10)


@_query("seq_idempotent")
def seq_idempotent(spark, d):
    return folds.allocate(enc.lineitem_requests(spark, d), maximum=50_000, block=10)


@_query("norev_spans", "SELECT 'users/' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS key, min((epoch_us(ts) // 1000)) AS earliest_l, max((epoch_us(ts) // 1000)) AS latest_l FROM events WHERE event_id % 11 = 0 AND NOT (event_type = 'error' OR (event_type = 'view' AND event_id % 3 = 0)) GROUP BY 1")
def norev_spans(spark, d):
    from .sources.storage import norev_spans as spans

    return spans(enc.events_mutations(spark, d))


_TRANSFER = "let v = get @key if is_null(v) then return 'none' end let n = rev(v) if n > 3 then set @key concat(v, '!') cmprev rev(v) return concat(v, to_str(n)) else return v end"


@_query(
    "script_set_mode",
    f"""SELECT c_custkey AS row_id, CASE WHEN h.key IS NULL THEN 'none' WHEN h.revision > 3 THEN h.value || CAST(h.revision AS VARCHAR) ELSE h.value END AS result
FROM customer LEFT JOIN {_HEAD} h ON h.key = 'users/' || lpad(CAST(c_custkey AS VARCHAR), 6, '0')""",
    "L",
)
def script_set_mode(spark, d):
    params = enc.table(spark, d, "customer").selectExpr("c_custkey as row_id", "concat('users/', lpad(cast(c_custkey as string), 6, '0')) as key")
    return scripts.run_set(_TRANSFER, params, enc.events_log(spark, d), NOW)[0]


@_query("script_sum_range", "SELECT '55' AS value")
def script_sum_range(spark, d):
    out = scripts.Session(None, NOW).run("let s = 0 for i in 1..10 do let s = s + i end return s")
    return spark.createDataFrame([(str(out.value),)], "value string")


@_query(
    "txns_to_validate",
    "SELECT o_orderkey AS txn_id FROM orders WHERE o_custkey % 3 = 0 OR o_orderpriority = '1-URGENT'",
)
def txns_to_validate(spark, d):
    txns = enc.table(spark, d, "orders").selectExpr(
        "o_orderkey as txn_id",
        "case when o_custkey % 3 = 0 then 'Optimistic' else 'Pessimistic' end as locking",
        "case when o_orderpriority = '1-URGENT' then 'TrackAndValidate' else 'None' end as read_validation",
    )
    return visibility.must_validate(txns).select("txn_id")


def _acquired(requests: str, held: str, on: str) -> str:
    """SQL of ``visibility.acquire`` over two relations."""
    valid = "txn_id <> 0 AND expires_ms >= 0"
    return f"""SELECT seq, txn_id, {on}, status, holder, CASE WHEN status = 'Locked' AND expires_ms > 0 THEN {_CUT} + expires_ms END AS expires_l FROM (
SELECT r.*, coalesce(h.txn_id, f.txn_id) AS holder, CASE WHEN NOT (r.txn_id <> 0 AND r.expires_ms >= 0) THEN 'Errored' WHEN r.txn_id = coalesce(h.txn_id, f.txn_id) THEN 'Locked' ELSE 'AlreadyLocked' END AS status
FROM {requests} r LEFT JOIN (SELECT * FROM {held} WHERE expires_l IS NULL OR expires_l > {_CUT}) h USING ({on})
LEFT JOIN (SELECT {on}, arg_min(txn_id, seq) AS txn_id FROM {requests} WHERE {valid} GROUP BY 1) f USING ({on}))"""


_ENDS = f"CASE WHEN {{0}} % 11 <> 0 THEN {_CUT} + ({{0}} % 7 - 3) * 1000 END"


@_query(
    "key_locks",
    f"""SELECT * FROM (WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS seq, l_orderkey % 50 AS txn_id, 'part/' || CAST(l_partkey AS VARCHAR) AS key, CAST(l_linenumber - 2 AS BIGINT) * 1000 AS expires_ms FROM lineitem),
h AS (SELECT 'part/' || CAST(p_partkey * 2 AS VARCHAR) AS key, p_partkey % 50 AS txn_id, {_ENDS.format("p_partkey")} AS expires_l FROM part)
{_acquired("r", "h", "key")})""",
)
def key_locks(spark, d):
    asked = enc.table(spark, d, "lineitem").selectExpr(
        "l_orderkey * 10 + l_linenumber as seq", "l_orderkey % 50 as txn_id", "concat('part/', cast(l_partkey as string)) as key", "cast(l_linenumber - 2 as bigint) * 1000 as expires_ms"
    )
    held = enc.table(spark, d, "part").selectExpr("concat('part/', cast(p_partkey * 2 as string)) as key", "p_partkey % 50 as txn_id", f"{_ENDS.format('p_partkey')} as expires_l")
    return visibility.acquire(asked, held, _CUT)


_BUCKET = "CASE WHEN o_orderkey % 2 = 0 THEN 'orders/' || o_orderpriority ELSE 'space/' || CAST(o_custkey {0} 10 AS {1}) END"


@_query(
    "prefix_locks",
    f"""SELECT * FROM (WITH {_WITH["M"]}, q AS (SELECT o_orderkey AS seq, o_custkey % 20 AS txn_id, {_BUCKET.format("//", "VARCHAR")} AS bucket, CAST(o_orderkey % 5 - 1 AS BIGINT) * 1000 AS expires_ms FROM orders),
h AS (SELECT 'space/' || CAST(c_custkey // 10 AS VARCHAR) AS bucket, max(c_custkey) % 20 AS txn_id, {_ENDS.format("max(c_custkey)")} AS expires_l FROM customer GROUP BY 1),
s AS (SELECT key_space FROM M GROUP BY 1 HAVING count(*) > 1), r AS (SELECT * FROM q WHERE bucket NOT IN (SELECT key_space FROM s))
{_acquired("r", "h", "bucket")} UNION ALL SELECT seq, txn_id, bucket, 'Unsupported', NULL, NULL FROM q WHERE bucket IN (SELECT key_space FROM s))""",
)
def prefix_locks(spark, d):
    asked = enc.table(spark, d, "orders").selectExpr(
        "o_orderkey as seq", "o_custkey % 20 as txn_id", f"{_BUCKET.format('div', 'STRING')} as bucket", "cast(o_orderkey % 5 - 1 as bigint) * 1000 as expires_ms"
    )
    held = enc.table(spark, d, "customer").groupBy(F.expr("concat('space/', cast(c_custkey div 10 as string))").alias("bucket")).agg(F.max("c_custkey").alias("k"))
    held = held.selectExpr("bucket", "k % 20 as txn_id", f"{_ENDS.format('k')} as expires_l")
    return visibility.acquire_prefixes(asked, held, enc.order_map(spark, d), _CUT)


@_query(
    "route_by_mode",
    """SELECT O.key, O.bucket AS key_space, 'range' AS mode, partition_id, generation, partition_id IS NOT NULL AS covered
FROM O LEFT JOIN M ON O.bucket = M.key_space AND end_key IS NOT NULL AND (start_key IS NULL OR O.key >= start_key) AND O.key < end_key
UNION ALL SELECT key, bucket, 'hash', NULL, 0, TRUE FROM L""",
    "OML",
)
def route_by_mode(spark, d):
    known = enc.order_map(spark, d)
    keys = enc.orders_log(spark, d).select("key").union(enc.events_log(spark, d).select("key"))
    out = ranges.route(keys, known, known.where("end_key is not null"), 8)
    return out.withColumn("partition_id", F.when(F.col("mode") == "range", F.col("partition_id")))


@_query(
    "key_space_admin",
    """SELECT key_space, count(*) AS ranges, max(generation) AS generation FROM (SELECT key_space, generation FROM M WHERE key_space <> 'orders/5-LOW'
UNION ALL SELECT DISTINCT 'space/' || CAST(c_custkey // 10 AS VARCHAR), CAST(1 AS BIGINT) FROM customer UNION ALL SELECT 'orders/meta', 1) GROUP BY 1""",
    "M",
)
def key_space_admin(spark, d):
    new = enc.table(spark, d, "customer").selectExpr("concat('space/', cast(c_custkey div 10 as string)) as key_space", "2 as partition_id")
    new = new.union(spark.sql("select explode(array('orders/1-URGENT', 'orders/meta')), 2"))
    known = ranges.register_spaces(enc.order_map(spark, d), new)
    return ranges.list_spaces(ranges.remove_spaces(known, spark.sql("select explode(array('orders/5-LOW', 'orders/meta', 'nowhere')) as key_space")))


@_query("child_counts", "SELECT key, count(*) AS n FROM L WHERE key >= 'users/000020' AND key < 'users/000090' GROUP BY key", "L")
def child_counts(spark, d):
    return ranges.child_counts(enc.events_log(spark, d).groupBy("key").agg(F.count("*").alias("n")), "users/000020", "users/000090")


@_query(
    "idempotency_pruning",
    f"""WITH e AS (SELECT l_returnflag AS name, CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) AS idempotency_key, {_MS['lineitem']} AS created_l, l_quantity = 50 AS protected FROM lineitem),
a AS (SELECT *, row_number() OVER (PARTITION BY name, protected ORDER BY created_l DESC, idempotency_key DESC) AS n, count(*) FILTER (WHERE protected) OVER (PARTITION BY name) AS safe FROM e WHERE protected OR created_l > {_CUT - 365 * 24 * HOUR})
SELECT name, idempotency_key, created_l, protected FROM a WHERE protected OR n <= 900 - safe""",
)
def idempotency_pruning(spark, d):
    entries = enc.table(spark, d, "lineitem").selectExpr(
        "l_returnflag as name",
        "cast(l_orderkey * 10 + l_linenumber as string) as idempotency_key",
        "timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', l_shipdate) as created_l",
        "l_quantity = 50 as protected",
    )
    return retention.prune_idempotency(entries, _CUT, 900, 365 * 24 * HOUR)


@_query(
    "seq_get_delete",
    """SELECT n.name, CASE WHEN s.name IS NULL THEN 'NotFound' ELSE 'Got' END AS status, s.current, s.current AS reserved, CASE WHEN s.name IS NULL THEN 'NotFound' ELSE 'Deleted' END AS deleted
FROM (SELECT DISTINCT l_returnflag AS name FROM lineitem UNION SELECT DISTINCT l_linestatus FROM lineitem) n
LEFT JOIN (SELECT l_returnflag AS name, CAST(sum(l_linenumber) AS BIGINT) AS current FROM lineitem GROUP BY 1) s USING (name)""",
)
def seq_get_delete(spark, d):
    rows = enc.table(spark, d, "lineitem")
    names = rows.selectExpr("explode(array(l_returnflag, l_linestatus)) as name").distinct()
    records = folds.sequence_records(folds.allocate(enc.lineitem_requests(spark, d).withColumn("idempotency_key", F.lit(None).cast("string"))))
    records = storage.written(records, "records")
    gone, _ = folds.delete_sequences(records, names)
    return folds.get_sequences(records, names).join(gone.withColumnRenamed("status", "deleted"), "name")


@_query(
    "backup_starts",
    """SELECT part, coalesce(high + 1, floor, 1) AS start, coalesce(coalesce(high + 1, floor, 1) < floor, FALSE) AS full_needed FROM (SELECT CAST(n_nationkey AS BIGINT) AS part FROM nation)
LEFT JOIN (SELECT CAST(s_nationkey AS BIGINT) AS part, max(s_suppkey) AS high FROM supplier GROUP BY 1) USING (part)
LEFT JOIN (SELECT CAST(c_nationkey AS BIGINT) AS part, min(c_custkey) AS floor FROM customer GROUP BY 1) USING (part)""",
)
def backup_starts(spark, d):
    high = enc.table(spark, d, "supplier").groupBy(F.col("s_nationkey").cast("long").alias("part")).agg(F.max("s_suppkey").alias("high"))
    floor = enc.table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("long").alias("part")).agg(F.min("c_custkey").alias("floor"))
    return retention.backup_starts(enc.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("part")), high, floor)
