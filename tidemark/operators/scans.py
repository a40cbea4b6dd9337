"""Ordered scans: bucket, prefix and range, pages and cursors, merges of replicas and of unflushed writes."""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import reads

SCAN_LIMIT = 4096


def prefix_end(prefix: str) -> str | None:
    """The least string above all that begin with ``prefix``, by code point."""
    for i in range(len(prefix) - 1, -1, -1):
        if ord(prefix[i]) < 0x10FFFF:
            step = 0xE000 if ord(prefix[i]) == 0xD7FF else ord(prefix[i]) + 1
            return prefix[:i] + chr(step)
    return None


def _head(log: DataFrame, as_of_l: int | None, now_l: int | None) -> DataFrame:
    return reads.latest(log, now_l) if as_of_l is None else reads.as_of(log, as_of_l, now_l)


def by_bucket(log: DataFrame, bucket: str, exact: bool = False, limit: int | None = SCAN_LIMIT, as_of_l: int | None = None, now_l: int | None = None) -> DataFrame:
    """Live keys under a bucket in key order: all that begin with it, or with ``exact`` its own keys."""
    inside = log.where(F.col("bucket") == bucket if exact else F.col("key").startswith(bucket))
    out = _head(inside, as_of_l, now_l).orderBy("key")
    return out if limit is None else out.limit(limit)


def by_prefix(replicas: list[DataFrame], prefix: str, tombstones: bool = False, now_l: int | None = None) -> DataFrame:
    """The newest of each key over several replicas, by revision and then time; tombstones travel and are dropped last."""
    both = replicas[0]
    for r in replicas[1:]:
        both = both.unionByName(r)
    found = reads.newest(both.where(F.col("key").startswith(prefix)))
    live = reads.live(now_l)
    return found.where(live | (F.col("state") == "Deleted")) if tombstones else found.where(live)


def bounds(prefix: str = "", start: str | None = None, start_incl: bool = True, end: str | None = None, end_incl: bool = False):
    """The condition of a range on the key; an open end is that of the prefix."""
    key, out = F.col("key"), F.lit(True)
    if prefix:
        out = key.startswith(prefix)
    if start is not None:
        out = out & (key >= start if start_incl else key > start)
    if end is not None:
        out = out & (key <= end if end_incl else key < end)
    elif prefix and (top := prefix_end(prefix)) is not None:
        out = out & (key < top)
    return out


def by_range(log: DataFrame, prefix: str = "", start: str | None = None, start_incl: bool = True, end: str | None = None, end_incl: bool = False, limit: int | None = None, as_of_l: int | None = None, now_l: int | None = None) -> DataFrame:
    if limit is not None and limit <= 0:
        raise ValueError("a limit is positive")
    out = _head(log.where(bounds(prefix, start, start_incl, end, end_incl)), as_of_l, now_l).orderBy("key")
    return out if limit is None else out.limit(limit)


def encode_cursor(last_key: str, prefix: str, durability: str, as_of_l: int | None) -> str:
    return base64.urlsafe_b64encode(json.dumps([1, last_key, prefix, durability, as_of_l]).encode()).decode().rstrip("=")


def decode_cursor(cursor: str) -> tuple[str, str, str, int | None]:
    try:
        version, *rest = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
        last_key, prefix, durability, as_of_l = rest
    except (ValueError, TypeError) as e:
        raise ValueError("not a cursor") from e
    if version != 1:
        raise ValueError("a cursor of another version")
    return last_key, prefix, durability, as_of_l


def page(log: DataFrame, limit: int, prefix: str = "", cursor: str | None = None, durability: str = "P", as_of_l: int | None = None, **range_):
    """(rows, has_more, cursor of the next page or None): one page of at most ``limit`` rows."""
    if cursor is not None:
        last, prefix, durability, as_of_l = decode_cursor(cursor)
        range_ |= {"start": last, "start_incl": False}
    rows = by_range(log, prefix, limit=limit + 1, as_of_l=as_of_l, **range_).collect()
    more = len(rows) > limit
    rows = rows[:limit]
    return rows, more, encode_cursor(rows[-1]["key"], prefix, durability, as_of_l) if more else None


def stream(log: DataFrame, as_of_l: int, **range_) -> Iterator:
    """All rows of a range at one time, in order, a partition at a time."""
    return by_range(log, as_of_l=as_of_l, **range_).toLocalIterator()


def overlay(store: DataFrame, queued: DataFrame) -> DataFrame:
    """Writes that wait in a queue over the store: of each key and revision the later write counts."""
    both = store.withColumn("__q", F.lit(0)).unionByName(queued.withColumn("__q", F.lit(1)))
    last = Window.partitionBy("key").orderBy(F.desc("revision"), F.desc("ts_l"), F.desc("__q"))
    return both.withColumn("__r", F.row_number().over(last)).where("__r = 1").drop("__r", "__q")
