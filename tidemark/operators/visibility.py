"""Transactions as relations: prepared intents, read validation, lock conflicts, atomic commit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def intent_view(page: DataFrame, intents: DataFrame, at_l: int, own_keys: DataFrame | None = None, now_l: int | None = None) -> DataFrame:
    """(key, status, value, revision): a page of live keys with the intents that are visible at a time merged in.

    A committed intent replaces, hides or adds its key; an undecided one that a
    read at this time depends on makes its row MustRetry.  Keys the reader wrote
    itself ignore foreign intents.
    """
    if own_keys is not None:
        intents = intents.join(own_keys.select("key"), "key", "left_anti")
    due = intents.where((F.col("commit_l") <= at_l) & (F.col("resolution") != "Aborted")).select(
        "key", "resolution", F.col("state").alias("i_state"), F.col("value").alias("i_value"), F.col("revision").alias("i_rev"), F.col("expires_l").alias("i_exp")
    )
    both = page.select("key", "value", "revision", F.lit(True).alias("there")).join(due, "key", "full")
    expired = F.lit(False) if now_l is None else F.coalesce(F.col("i_exp") < now_l, F.lit(False))
    hidden = (F.col("resolution") == "Committed") & ((F.col("i_state") == "Deleted") | expired)
    status = F.when(F.col("resolution") == "Pending", "MustRetry").otherwise("Visible")
    override = F.col("resolution") == "Committed"
    return both.where(~F.coalesce(hidden, F.lit(False))).select(
        "key",
        status.alias("status"),
        F.when(override, F.col("i_value")).otherwise(F.col("value")).alias("value"),
        F.when(override, F.col("i_rev")).otherwise(F.col("revision")).alias("revision"),
    )


def validate_reads(reads: DataFrame, head: DataFrame, writes: DataFrame | None = None) -> DataFrame:
    """(txn_id, conflicts, aborted): transactions whose reads no longer hold, their own writes aside."""
    if writes is not None:
        reads = reads.join(writes.select("txn_id", "key"), ["txn_id", "key"], "left_anti")
    now = head.select("key", F.col("revision").alias("now_rev"))
    held = reads.join(now, "key", "left")
    changed = (F.col("existed") != F.col("now_rev").isNotNull()) | (F.col("existed") & (F.col("revision") != F.col("now_rev")))
    return held.groupBy("txn_id").agg(F.count_if(F.coalesce(changed, F.lit(True))).alias("conflicts")).withColumn("aborted", F.col("conflicts") > 0)


def early_conflicts(reads: DataFrame, head: DataFrame) -> DataFrame:
    """Keys whose head has moved past the revision a transaction saw."""
    now = head.select("key", F.col("revision").alias("now_rev"))
    return reads.where("existed").join(now, "key").where("now_rev > revision").select("txn_id", "key", "revision", "now_rev")


def _overlap(a: str, b: str) -> Column:
    """Two intervals meet; null bounds are open, equal bounds meet if both ends are inclusive."""
    return F.expr(
        f"({a}.start_key is null or {b}.end_key is null or {a}.start_key < {b}.end_key or ({a}.start_key = {b}.end_key and {a}.start_incl and {b}.end_incl))"
        f" and ({b}.start_key is null or {a}.end_key is null or {b}.start_key < {a}.end_key or ({b}.start_key = {a}.end_key and {b}.start_incl and {a}.end_incl))"
    )


def live_ranges(locks: DataFrame, now_l: int) -> DataFrame:
    """Range locks end at their expiry, unlike values, which still live in that millisecond."""
    return locks.where(F.col("expires_l").isNull() | (F.col("expires_l") > now_l))


def range_conflicts(locks: DataFrame) -> DataFrame:
    """Pairs of overlapping locks of two transactions in one bucket, one of them at least exclusive."""
    pair = (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.txn_id") < F.col("b.txn_id"))
    pair = pair & ((F.col("a.mode") == "X") | (F.col("b.mode") == "X")) & _overlap("a", "b")
    return locks.alias("a").join(locks.alias("b"), pair).select(
        F.col("a.bucket").alias("bucket"), F.col("a.txn_id").alias("txn_a"), F.col("b.txn_id").alias("txn_b"), F.concat("a.mode", "b.mode").alias("modes")
    )


def covered(keys: DataFrame, locks: DataFrame) -> DataFrame:
    """(bucket, key, txn_id, mode): the locks whose range holds a key."""
    inside = F.expr(
        "k.bucket = l.bucket and (l.start_key is null or k.key > l.start_key or (l.start_incl and k.key = l.start_key))"
        " and (l.end_key is null or k.key < l.end_key or (l.end_incl and k.key = l.end_key))"
    )
    return keys.alias("k").join(locks.alias("l"), inside).select("k.bucket", "k.key", "l.txn_id", "l.mode")


def commit_conflicts(reads: DataFrame, writes: DataFrame, intents: DataFrame, locks: DataFrame, now_l: int) -> DataFrame:
    """Transactions that may not commit: a read-only key with a foreign live intent, a written key under a foreign range lock."""
    only = reads.select("txn_id", "key").join(writes.select("txn_id", "key"), ["txn_id", "key"], "left_anti")
    live = intents.where("resolution = 'Pending'").select(F.col("txn_id").alias("other"), "key")
    a = only.join(live, "key").where("other != txn_id").select("txn_id", "key", F.lit("intent").alias("cause"))
    held = live_ranges(locks, now_l).withColumnRenamed("txn_id", "other")
    inside = F.expr(
        "w.bucket = l.bucket and (l.start_key is null or w.key > l.start_key or (l.start_incl and w.key = l.start_key))"
        " and (l.end_key is null or w.key < l.end_key or (l.end_incl and w.key = l.end_key)) and l.other != w.txn_id"
    )
    b = writes.alias("w").join(held.alias("l"), inside).select("w.txn_id", "w.key", F.lit("range lock").alias("cause"))
    return a.union(b).distinct()


def commit_atomically(votes: DataFrame) -> DataFrame:
    """(txn_id, keys, decision) from (txn_id, key, durability, prepared): all keys or none; a durable decision takes no ephemeral key."""
    return votes.groupBy("txn_id").agg(
        F.count("*").alias("keys"),
        F.bool_and("prepared").alias("ready"),
        (F.bool_or(F.col("durability") == "E") & F.bool_or(F.col("durability") == "P")).alias("mixed"),
    ).select("txn_id", "keys", F.when(F.col("mixed"), "Rejected").when(F.col("ready"), "Committed").otherwise("Aborted").alias("decision"))


def priority_order(waiting: DataFrame, now_l: int, threshold_ms: int, high: int = 3) -> DataFrame:
    """(seq, effective, place): waiting transactions by priority, which waiting raises up to ``high``."""
    aged = F.least(F.greatest(F.lit(high), "priority"), F.col("priority") + F.floor((F.lit(now_l) - F.col("since_l")) / threshold_ms))
    effective = aged.cast("long")
    return waiting.withColumn("effective", effective).selectExpr("seq", "effective", "cast(row_number() over (order by effective desc, seq) as bigint) as place")


def must_validate(transactions: DataFrame) -> DataFrame:
    """The transactions whose reads are validated before they commit: all optimistic ones, others if they ask for it."""
    return transactions.where((F.col("locking") == "Optimistic") | (F.col("read_validation") == "TrackAndValidate"))


def acquire(requests: DataFrame, held: DataFrame, now_l: int, on: str = "key") -> DataFrame:
    """(seq, txn_id, ``on``, status, holder, expires_l): exclusive locks on keys or buckets, asked for at one time.

    ``requests`` has seq, txn_id, expires_ms and the column ``on``; ``held`` has
    ``on``, txn_id and expires_l.  A lock that has not ended keeps its holder,
    who may renew it; a free one goes to the first valid request.  A request
    without a transaction or with a negative lease is Errored, and a lease of 0
    never ends.
    """
    valid = F.coalesce((F.col("txn_id") != 0) & (F.col("expires_ms") >= 0), F.lit(False))
    live = live_ranges(held, now_l).select(on, F.col("txn_id").alias("live"))
    # one row for each lock, so that many requests for one lock are combined before they are shuffled
    first = requests.where(valid).groupBy(on).agg(F.min_by("txn_id", "seq").alias("first"))
    out = requests.join(live, on, "left").join(first, on, "left").withColumn("holder", F.coalesce("live", "first"))
    status = F.when(~valid, "Errored").when(F.col("holder") == F.col("txn_id"), "Locked").otherwise("AlreadyLocked")
    end = F.when((F.col("status") == "Locked") & (F.col("expires_ms") > 0), F.lit(now_l) + F.col("expires_ms"))
    return out.withColumn("status", status).select("seq", "txn_id", on, "status", "holder", end.cast("long").alias("expires_l"))


def acquire_prefixes(requests: DataFrame, held: DataFrame, ranges: DataFrame, now_l: int) -> DataFrame:
    """As ``acquire``, for whole buckets; one that lies in several ranges is Unsupported."""
    split = ranges.groupBy(F.col("key_space").alias("bucket")).agg((F.count("*") > 1).alias("split"))
    whole = requests.join(split.where("split"), "bucket", "left_anti")
    refused = requests.join(split.where("split"), "bucket").select(
        "seq", "txn_id", "bucket", F.lit("Unsupported").alias("status"), F.lit(None).cast("long").alias("holder"), F.lit(None).cast("long").alias("expires_l")
    )
    return acquire(whole, held, now_l, "bucket").withColumn("holder", F.col("holder").cast("long")).unionByName(refused)


def stamped(granted: DataFrame, keys: DataFrame, held: DataFrame, now_l: int) -> DataFrame:
    """(key, txn_id): the keys of locked buckets that the lock marks; a key that another transaction holds stays with it."""
    own = granted.where("status = 'Locked'").select("bucket", F.col("holder").alias("txn_id")).distinct()
    live = live_ranges(held, now_l).select("key", F.col("txn_id").alias("other"))
    out = keys.join(own, "bucket").join(live, "key", "left")
    return out.where("other is null or other = txn_id").select("key", "txn_id")
