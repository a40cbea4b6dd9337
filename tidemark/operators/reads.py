"""Point reads on a revision log: latest, by revision, as of a time, existence, many keys at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def live(now_l: int | None) -> Column:
    """Set, and not expired: an expiry is over strictly after its millisecond."""
    alive = F.col("state") == "Set"
    return alive if now_l is None else alive & (F.col("expires_l").isNull() | (F.col("expires_l") >= now_l))


def newest(log: DataFrame) -> DataFrame:
    """The newest revision of each key, tombstones included."""
    last = Window.partitionBy("key").orderBy(F.desc("revision"), F.desc("ts_l"))
    return log.withColumn("__r", F.row_number().over(last)).where("__r = 1").drop("__r")


def latest(log: DataFrame, now_l: int | None = None) -> DataFrame:
    return newest(log).where(live(now_l))


def by_revision(log: DataFrame, revision: int) -> DataFrame:
    """An exact revision, whatever its state and expiry."""
    return log.where(F.col("revision") == revision)


def as_of(log: DataFrame, as_of_l: int, now_l: int | None = None, max_revision: int | None = None, tombstones: bool = False) -> DataFrame:
    """The state at the end of a millisecond; expiry is held against ``now_l``, not against that time."""
    seen = log.where(F.col("ts_l") <= as_of_l)
    if max_revision is not None:
        seen = seen.where(F.col("revision") <= max_revision)
    found = newest(seen)
    return found if tombstones else found.where(live(now_l))


def get_many(log: DataFrame, requests: DataFrame, now_l: int | None = None) -> DataFrame:
    """Each requested (key, revision): the named revision, or with a null one the latest; null values where there is none."""
    head = latest(log, now_l).select("key", F.col("revision").alias("r"), "value", F.lit(True).alias("head"))
    exact = log.select("key", F.col("revision").alias("r"), "value", F.lit(False).alias("head"))
    asked = requests.select("key", F.col("revision").alias("asked"))
    now = asked.where("asked is null").join(head, "key", "left")
    then = asked.where("asked is not null").alias("a").join(exact.alias("e"), F.expr("a.key = e.key and asked = r"), "left").select("a.key", "asked", "r", "value")
    return now.select("key", "asked", "r", "value").union(then).withColumn("found", F.col("r").isNotNull()).withColumnRenamed("r", "revision")


def exists(log: DataFrame, keys: DataFrame, as_of_l: int | None = None, now_l: int | None = None) -> DataFrame:
    """Whether each key is visible, and its revision (-1 where it is not)."""
    found = latest(log, now_l) if as_of_l is None else as_of(log, as_of_l, now_l)
    hit = found.select("key", F.col("revision").alias("r"))
    return keys.select("key").join(hit, "key", "left").select("key", F.col("r").isNotNull().alias("found"), F.coalesce("r", F.lit(-1)).alias("revision"))


def overlay_own(log_head: DataFrame, own: DataFrame) -> DataFrame:
    """A reader's own staged writes over the head: its value, or nothing where it deleted the key."""
    mine = own.select("key", "revision", "value", "state")
    rest = log_head.select("key", "revision", "value", "state").join(mine.select("key"), "key", "left_anti")
    return rest.union(mine).where("state = 'Set'")


def exists_at(log: DataFrame, requests: DataFrame) -> DataFrame:
    """Whether each requested (key, revision) was written, whatever its state and expiry since."""
    there = log.select("key", "revision", F.lit(True).alias("hit")).distinct()
    return requests.select("key", "revision").join(there, ["key", "revision"], "left").select("key", "revision", F.coalesce("hit", F.lit(False)).alias("found"))
