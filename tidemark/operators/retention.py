"""Retention, snapshots, checkpoints and restore."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.storage import written
from . import reads


def effective_floor(holds: DataFrame, now_l: int) -> DataFrame:
    """(floor_l): the oldest time that a live hold protects; null without one."""
    return holds.where(F.col("lease_l") >= now_l).agg(F.min("ts_l").alias("floor_l"))


def hold_events(events: DataFrame) -> DataFrame:
    """(hold_id, holder, ts_l, lease_l): holds after acquire, renew and release events; a repeated acquire renews."""
    last = events.groupBy("holder", "ts_l").agg(F.max_by(F.struct("op", "lease_l"), "seq").alias("e"), F.min("seq").alias("hold_id"))
    return last.where("e.op != 'release'").select("hold_id", "holder", "ts_l", "e.lease_l")


def trim(log: DataFrame, keep: int = 16, floor_l: int | None = None) -> DataFrame:
    """The newest ``keep`` revisions of each key, and the one that a snapshot at the floor reads."""
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("revision")))
    out = log.withColumn("__n", rank)
    stay = F.col("__n") <= keep
    if floor_l is not None:
        edge = F.max(F.when(F.col("ts_l") <= floor_l, F.col("revision"))).over(Window.partitionBy("key"))
        out = out.withColumn("__f", edge)
        stay = stay | F.coalesce(F.col("revision") == F.col("__f"), F.lit(False))
        return out.where(stay).drop("__n", "__f")
    return out.where(stay).drop("__n")


def prunable(log: DataFrame, keep: int | None = None, older_l: int | None = None, floor_l: int | None = None) -> DataFrame:
    """Revisions that retention may delete: beyond the count or older than the age, not the head, and below the floor's revision.

    With a floor, a key without a revision at or before it keeps everything.
    """
    out = log.withColumn("__n", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("revision"))))
    beyond = F.lit(False)
    if keep is not None:
        beyond = beyond | (F.col("__n") > keep)
    if older_l is not None:
        beyond = beyond | (F.col("ts_l") < older_l)
    rule = beyond & (F.col("__n") > 1)
    if floor_l is not None:
        edge = F.max(F.when(F.col("ts_l") <= floor_l, F.col("revision"))).over(Window.partitionBy("key"))
        out = out.withColumn("__f", F.coalesce(edge, F.lit(-1)))
        rule = rule & (F.col("revision") < F.col("__f"))
        return out.where(rule).drop("__n", "__f")
    return out.where(rule).drop("__n")


def prune(log: DataFrame, **how) -> DataFrame:
    return log.join(prunable(log, **how).select("key", "revision"), ["key", "revision"], "left_anti").select(*log.columns)


def pruned_history_floor(log: DataFrame, pruned: DataFrame) -> DataFrame:
    """(floor_l): reads before this time may miss history: the latest of the pruned keys' oldest survivors."""
    keys = pruned.select("key").distinct()
    oldest = log.join(pruned.select("key", "revision"), ["key", "revision"], "left_anti").join(keys, "key", "left_semi").groupBy("key").agg(F.min("ts_l").alias("o"))
    return oldest.agg(F.max("o").alias("floor_l"))


def checkpoint(log: DataFrame, cut_l: int) -> DataFrame:
    """The newest revision of each key at a time, tombstones included."""
    return reads.as_of(log, cut_l, tombstones=True)


def inexact_keys(log: DataFrame, spans: DataFrame, cut_l: int) -> DataFrame:
    """Keys of which no exact checkpoint exists: an unarchived write before the cut is newer than their last revision there."""
    edge = checkpoint(log, cut_l).select("key", F.col("ts_l").alias("edge_l"))
    late = F.least("latest_l", F.when(F.col("latest_l") <= cut_l, F.col("latest_l")).otherwise(F.col("earliest_l")))
    return spans.where(F.col("earliest_l") <= cut_l).join(edge, "key", "left").where(late > F.coalesce("edge_l", F.lit(-1))).select("key")


def incremental(log: DataFrame, marks: DataFrame, index: str = "idx", partition: str = "part") -> DataFrame:
    """Records after their partition's high-water mark; a partition without one gives all."""
    high = marks.select(F.col(partition).alias("__p"), "high")
    return log.join(high, F.col(partition) == F.col("__p"), "left").where(F.col(index) > F.coalesce("high", F.lit(0))).drop("__p", "high")


def restore(base: DataFrame, increments: DataFrame, to_l: int) -> DataFrame:
    """The base and all later records up to a time, each key and revision once, whatever their order."""
    both = base.withColumn("__s", F.lit(0)).unionByName(increments.where(F.col("ts_l") <= to_l).withColumn("__s", F.lit(1)))
    last = Window.partitionBy("key", "revision").orderBy(F.desc("__s"), F.desc("ts_l"))
    return both.withColumn("__r", F.row_number().over(last)).where("__r = 1").drop("__r", "__s")


def recoverable(to_l: int, now_l: int, window_ms: int) -> bool:
    return now_l - window_ms <= to_l <= now_l


def safe_time(in_flight: DataFrame, committed: DataFrame) -> DataFrame:
    """(safe_l): just before the first commit in flight, or else the last commit."""
    a, b = in_flight.agg(F.min("commit_l").alias("m")), committed.agg(F.max("commit_l").alias("c"))
    return a.withColumn("one", F.lit(1)).join(b.withColumn("one", F.lit(1)), "one").select(F.coalesce(F.col("m") - 1, F.col("c")).alias("safe_l"))


def index_at(log: DataFrame, at_l: int, index: str = "idx") -> DataFrame:
    """(first_at_or_after, last_at_or_before) log index of a time."""
    return log.agg(F.min(F.when(F.col("ts_l") >= at_l, F.col(index))).alias("first_at_or_after"), F.max(F.when(F.col("ts_l") <= at_l, F.col(index))).alias("last_at_or_before"))


def chains(spark: SparkSession, manifests: DataFrame) -> DataFrame:
    """(leaf_id, backup_id, depth): every backup that each leaf needs, itself at depth 0."""
    known = manifests.select(F.col("backup_id").alias("node"))
    up = manifests.where("parent_id is not null").select(F.col("backup_id").alias("node"), F.col("parent_id").alias("top"))
    leaves = known.join(up.select(F.col("top").alias("node")).distinct(), "node", "left_anti")
    # jumps of 1, 2, 4, ... steps; a parent that has no manifest ends its chain
    jumps = [written(up.join(known.withColumnRenamed("node", "top"), "top", "left_semi").select("node", "top"), "jump")]
    most = manifests.count()
    while not jumps[-1].isEmpty():
        if 1 << (len(jumps) - 1) > most:
            raise ValueError("backups are their own ancestors")
        last = jumps[-1]
        jumps.append(written(last.join(last.toDF("top", "next"), "top").select("node", F.col("next").alias("top")), "jump"))
    # a depth is a sum of different jumps: the largest first, every leaf meets each of its ancestors once
    found = leaves.select(F.col("node").alias("leaf_id"), F.col("node").alias("backup_id"), F.lit(0).alias("depth"))
    for k in reversed(range(len(jumps) - 1)):
        far = found.join(jumps[k].withColumnRenamed("node", "backup_id"), "backup_id")
        found = written(found.unionByName(far.select("leaf_id", F.col("top").alias("backup_id"), (F.col("depth") + (1 << k)).alias("depth"))), "chains")
    return found


def broken_chains(manifests: DataFrame) -> DataFrame:
    """(backup_id, problem): an increment without its parent, a full backup with one, or a range that does not follow its parent's."""
    up = manifests.select(F.col("backup_id").alias("parent_id"), F.col("last_index").alias("parent_last"), F.lit(True).alias("found"))
    problem = (
        F.when(F.expr("type = 'full' and parent_id is not null"), "full with a parent")
        .when(F.expr("type = 'incremental' and found is null"), "parent missing")
        .when(F.expr("type = 'incremental' and first_index != parent_last + 1"), "range does not follow")
    )
    return manifests.join(up, "parent_id", "left").withColumn("problem", problem).where("problem is not null").select("backup_id", "problem")


def plan_chains(rows: list[dict], now_l: int, max_chains: int | None = None, max_age_ms: int | None = None, max_bytes: int | None = None) -> list[str]:
    """Backups to delete, the deepest first.  Runs on the driver: a catalogue has one row for each backup taken.

    Chains are judged from the newest leaf on; the newest stays, and a kept leaf keeps its ancestors.
    """
    by_id = {r["backup_id"]: r for r in rows}
    parents = {r["parent_id"] for r in rows}

    def chain(leaf: str | None) -> list[str]:
        out = []
        while leaf is not None and leaf in by_id:
            out.append(leaf)
            leaf = by_id[leaf]["parent_id"]
        return out

    leaves = sorted((r for r in rows if r["backup_id"] not in parents), key=lambda r: (-r["created_l"], r["backup_id"]))
    kept, held, used = set(), 0, 0
    for n, leaf in enumerate(leaves):
        own = chain(leaf["backup_id"])
        more = sum(by_id[b]["bytes"] for b in own if b not in kept)
        over = (
            (max_chains is not None and held >= max_chains)
            or (max_age_ms is not None and now_l - leaf["created_l"] > max_age_ms)
            or (max_bytes is not None and used + more > max_bytes)
        )
        if n == 0 or not over:
            kept.update(own)
            held, used = held + 1, used + more
    gone = [b for b in by_id if b not in kept]
    return sorted(gone, key=lambda b: (-len(chain(b)), b))


def orphans(artifacts: DataFrame, manifests: DataFrame) -> DataFrame:
    return artifacts.join(manifests.select("backup_id"), "backup_id", "left_anti")


def prune_idempotency(entries: DataFrame, now_l: int, cap: int, ttl_ms: int) -> DataFrame:
    """The idempotency entries (name, idempotency_key, created_l, protected) that stay.

    Entries as old as the lifetime go first, then the oldest beyond ``cap`` in
    each sequence, the lesser key first among equals; a protected entry stays.
    A lifetime or cap of 0 does not prune.
    """
    out = entries
    if ttl_ms > 0 and now_l > 0:
        out = out.where(F.col("protected") | (F.col("created_l") > now_l - ttl_ms))
    if cap <= 0:
        return out
    safe = out.where("protected")
    room = safe.groupBy("name").agg(F.count("*").alias("__safe"))
    newest = Window.partitionBy("name").orderBy(F.desc("created_l"), F.desc("idempotency_key"))
    # the bare cap cuts the ranking off before the shuffle; the room that protected entries leave is less
    rest = out.where("not protected").withColumn("__n", F.row_number().over(newest)).where(F.col("__n") <= cap)
    rest = rest.join(room, "name", "left").where(F.col("__n") <= cap - F.coalesce("__safe", F.lit(0)))
    return safe.unionByName(rest.select(*entries.columns))


def backup_starts(partitions: DataFrame, marks: DataFrame, floors: DataFrame) -> DataFrame:
    """(part, start, full_needed): where each partition's increment begins.

    After its parent's high-water mark, or for a new partition at the compaction
    floor or 1; what lies below the floor is gone, which calls for a full backup.
    """
    out = partitions.select("part").join(marks.select("part", "high"), "part", "left").join(floors.select("part", "floor"), "part", "left")
    start = F.coalesce(F.col("high") + 1, F.col("floor"), F.lit(1)).cast("long")
    return out.withColumn("start", start).select("part", "start", F.coalesce(F.col("start") < F.col("floor"), F.lit(False)).alias("full_needed"))
