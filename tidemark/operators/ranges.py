"""Range partitions of a key space: routing, checking, splitting, merging and heavy keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that may be broadcast; a larger level of a map's tree is joined by a shuffle instead.
MAP_ROWS = 100_000

#: Children of a node in a map's tree.
FAN = 16


def route_hash(keys: DataFrame, pool: int) -> DataFrame:
    """(key, bucket, partition_id): all keys of a bucket in one partition."""
    return keys.select("key", "bucket", _home("bucket", pool).alias("partition_id"))


def _home(bucket: str, pool: int):
    return (F.pmod(F.xxhash64(F.coalesce(bucket, F.lit(""))), F.lit(pool)) + 1).cast("int")


def route_range(keys: DataFrame, ranges: DataFrame) -> DataFrame:
    """(key, key_space, partition_id, generation): the descriptor that holds each key; null where none does.

    The last descriptor that begins at or before the key is asked whether it
    holds it.  It is found down a tree of the map, so that a key meets ``FAN``
    rows a level, whatever the size of the map.
    """
    from ..sources.storage import written

    k = keys.select("key", F.col("bucket").alias("key_space"))
    order = Window.partitionBy("key_space").orderBy("s", F.col("end_key").asc_nulls_last(), "partition_id")
    m = ranges.select("key_space", F.coalesce("start_key", F.lit("")).alias("s"), "end_key", "partition_id", "generation")
    m = written(m.withColumn("n", F.row_number().over(order).cast("long") - 1), "map")
    longest, total = m.agg(F.coalesce(F.max("n") + 1, F.lit(0)), F.count("*")).first()
    depth = 0
    while FAN ** (depth + 1) < longest:
        depth += 1
    out = k.withColumn("node", F.lit(0).cast("long"))
    for level in range(depth, -1, -1):
        width = FAN**level
        first = m.where(F.col("n") % width == 0)
        nodes = first.select(
            F.col("key_space").alias("space"),
            F.expr(f"n div {width * FAN}").alias("parent"),
            F.expr(f"n div {width}").alias("child"),
            F.col("s").alias("from"),
            F.lead("s").over(Window.partitionBy("key_space").orderBy("n")).alias("until"),
            *[F.col(c) for c in ("end_key", "partition_id", "generation") if level == 0],
        )
        hit = F.expr("key_space = space and node = parent and key >= from and (until is null or key < until)")
        out = out.join(F.broadcast(nodes) if total // width <= MAP_ROWS else nodes, hit, "left")
        out = out.select("key", "key_space", F.col("child").alias("node"), *nodes.columns[5:])
    held = F.expr("end_key is null or key < end_key")
    return out.select("key", "key_space", *[F.when(held, F.col(c)).alias(c) for c in ("partition_id", "generation")])


def intersecting(ranges: DataFrame, key_space: str, start: str | None, end: str | None) -> DataFrame:
    """The descriptors that meet [start, end), clipped to it."""
    out = ranges.where(F.col("key_space") == key_space)
    if end is not None:
        out = out.where(F.col("start_key").isNull() | (F.col("start_key") < end))
    if start is not None:
        out = out.where(F.col("end_key").isNull() | (F.col("end_key") > start))
    low = F.col("start_key") if start is None else F.greatest("start_key", F.lit(start))
    high = F.col("end_key") if end is None else F.least("end_key", F.lit(end))
    return out.select("key_space", "partition_id", low.alias("clip_start"), high.alias("clip_end"))


def validate_map(ranges: DataFrame) -> DataFrame:
    """(key_space, start_key, problem): ranges that are empty, open in the wrong place, or not flush with the next."""
    order = Window.partitionBy("key_space").orderBy(F.col("start_key").asc_nulls_first(), F.col("end_key").asc_nulls_last())
    out = ranges.withColumns({"n": F.row_number().over(order), "next_start": F.lead("start_key").over(order), "has_next": F.lead(F.lit(True)).over(order)})
    problem = (
        F.when(F.expr("start_key >= end_key"), "empty")
        .when(F.expr("start_key is null and n > 1"), "open start")
        .when(F.expr("end_key is null and has_next"), "open end")
        .when(F.expr("has_next and end_key < next_start"), "gap")
        .when(F.expr("has_next and (end_key > next_start or next_start is null)"), "overlap")
    )
    return out.withColumn("problem", problem).where("problem is not null").select("key_space", "start_key", "problem")


def fenced(requests: DataFrame, ranges: DataFrame) -> DataFrame:
    """Whether each routed request still names its partition's generation."""
    now = ranges.select("key_space", "partition_id", F.col("generation").alias("now"))
    return requests.join(now, ["key_space", "partition_id"], "left").withColumn("accepted", F.coalesce(F.col("generation") == F.col("now"), F.lit(False))).drop("now")


def split_points(keys: DataFrame, threshold: int, least: int) -> DataFrame:
    """(bucket, n, monotonic, split_key): the median key, or the 3/4 key where keys are only ever appended.

    ``keys`` has bucket, key, ts_l.  Appending: of the keys as new as the
    (n/4)-th newest at least 3/4 stand in the top quarter of the key order.
    """
    by_key = Window.partitionBy("bucket").orderBy("key")
    all_ = Window.partitionBy("bucket")
    newest = Window.partitionBy("bucket").orderBy(F.desc("ts_l"), "key")
    out = keys.withColumns({"i": F.row_number().over(by_key) - 1, "n": F.count("*").over(all_), "age": F.row_number().over(newest)})
    out = out.withColumn("bar", F.max(F.when(F.col("age") == F.greatest(F.lit(1), F.floor(F.col("n") / 4)), F.col("ts_l"))).over(all_))
    recent = F.col("ts_l") >= F.col("bar")
    upper = F.col("i") >= F.col("n") - F.greatest(F.lit(1), F.floor(F.col("n") / 4))
    out = out.withColumn("mono", F.sum((recent & upper).cast("int")).over(all_) * 4 >= F.sum(recent.cast("int")).over(all_) * 3)
    want = F.bround(F.col("n") * F.when(F.col("mono"), 0.75).otherwise(0.5)).cast("long")
    at = F.greatest(F.lit(least), F.least(want, F.col("n") - least))
    big = (F.col("n") >= threshold) & (F.col("n") >= 2 * least)
    return out.where(big & (F.col("i") == at)).select("bucket", "n", F.col("mono").alias("monotonic"), F.col("key").alias("split_key"))


def centroid_splits(writes: DataFrame, least: int) -> DataFrame:
    """(bucket, split_key, imbalance_left, total): the key that halves the writes best, the first of equals.

    ``writes`` has bucket, key, writes.  Buckets with fewer writes than keys have none.
    """
    order = Window.partitionBy("bucket").orderBy("key")
    all_ = Window.partitionBy("bucket")
    out = writes.withColumns(
        {
            "i": F.row_number().over(order) - 1,
            "n": F.count("*").over(all_),
            "total": F.sum("writes").over(all_),
            "left": F.coalesce(F.sum("writes").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        }
    )
    out = out.where((F.col("total") >= F.col("n")) & (F.col("i") >= least) & (F.col("n") - F.col("i") >= least))
    best = out.groupBy("bucket").agg(F.min(F.struct(F.abs(2 * F.col("left") - F.col("total")).alias("gap"), "i", "key", "left", "total")).alias("b"))
    return best.selectExpr("bucket", "b.key as split_key", "cast(greatest(b.left, b.total - b.left) as bigint) as heavier", "cast(b.total as bigint) as total")


def merge_candidates(sizes: DataFrame, least: int) -> DataFrame:
    """(key_space, left_id, right_id): neighbouring pairs below ``least`` keys, taken greedily from the left."""
    order = Window.partitionBy("key_space").orderBy(F.col("start_key").asc_nulls_first())
    out = sizes.withColumns({"n": F.row_number().over(order), "small": F.col("keys") < least})
    island = F.row_number().over(Window.partitionBy("key_space", "small").orderBy("n"))
    out = out.withColumn("island", F.col("n") - island).where("small")
    place = Window.partitionBy("key_space", "island").orderBy("n")
    out = out.withColumns({"place": F.row_number().over(place), "right_id": F.lead("partition_id").over(place)})
    return out.where("place % 2 = 1 and right_id is not null").select("key_space", F.col("partition_id").alias("left_id"), "right_id")


def range_counts(keys: DataFrame, ranges: DataFrame) -> DataFrame:
    """(key_space, start_key, partition_id, keys) for each descriptor."""
    n = route_range(keys, ranges).groupBy("key_space", "partition_id").agg(F.count("*").alias("n"))
    return ranges.join(n, ["key_space", "partition_id"], "left").select("key_space", "start_key", "partition_id", F.coalesce("n", F.lit(0)).alias("keys"))


def split_range(ranges: DataFrame, key_space: str, at: str, new_partition: int) -> DataFrame:
    """The map after a split: the right part goes to a new partition, both get the next generation."""
    hit = (F.col("key_space") == key_space) & F.expr(f"(start_key is null or start_key < '{at}') and (end_key is null or end_key > '{at}')")
    old = ranges.where(~F.coalesce(hit, F.lit(False)))
    left = ranges.where(hit).withColumns({"end_key": F.lit(at), "generation": F.col("generation") + 1})
    right = ranges.where(hit).withColumns({"start_key": F.lit(at), "generation": F.col("generation") + 1, "partition_id": F.lit(new_partition)})
    return old.unionByName(left).unionByName(right)


def merge_ranges(ranges: DataFrame, pairs: DataFrame) -> DataFrame:
    """The map after merging (key_space, left_id, right_id): the left partition keeps both, with the next generation."""
    right = ranges.select("key_space", F.col("partition_id").alias("right_id"), F.col("end_key").alias("right_end"), F.lit(True).alias("m"))
    grown = ranges.join(pairs.withColumnRenamed("left_id", "partition_id"), ["key_space", "partition_id"], "left").join(right, ["key_space", "right_id"], "left")
    gone = pairs.select("key_space", F.col("right_id").alias("partition_id"))
    grown = grown.withColumns({"end_key": F.when(F.col("m"), F.col("right_end")).otherwise(F.col("end_key")), "generation": F.col("generation") + F.col("m").isNotNull().cast("int")})
    return grown.select(*ranges.columns).join(gone, ["key_space", "partition_id"], "left_anti").select(*ranges.columns)


def load_gate(samples: DataFrame, rate: float, queue: int, window_ms: int) -> DataFrame:
    """(bucket, ts_l, open): the load has been over its bars at every sample of the window up to now, and for all of it."""
    hot = ((F.col("rate") >= rate) & (F.col("queue") >= queue)).cast("int")
    span = Window.partitionBy("bucket").orderBy("ts_l").rangeBetween(-window_ms, 0)
    begin = Window.partitionBy("bucket").orderBy("ts_l").rowsBetween(Window.unboundedPreceding, 0)
    held = (F.min(hot).over(span) == 1) & (F.col("ts_l") - F.min("ts_l").over(begin) >= window_ms)
    return samples.select("bucket", "ts_l", held.alias("open"))


def heavy_hitters(writes: DataFrame, k: int) -> DataFrame:
    return writes.groupBy("key").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key").limit(k)


def decay(counts: DataFrame, elapsed: int) -> DataFrame:
    """Counts after so many halvings; keys at 0 go."""
    return counts.withColumn("n", F.shiftright("n", min(elapsed, 63))).where("n > 0")


#: The generation of a key space's first descriptor.
FIRST_GENERATION = 1


def route(keys: DataFrame, spaces: DataFrame, ranges: DataFrame, pool: int) -> DataFrame:
    """(key, key_space, mode, partition_id, generation, covered): by range in the registered ``spaces``, by hash elsewhere.

    A key's space is all before its last slash, or the whole key.  A key of a
    registered space that no descriptor holds is not covered.
    """
    from ..sources.storage import written

    space = F.when(F.contains("key", F.lit("/")), F.expr("left(key, length(key) - length(substring_index(key, '/', -1)) - 1)")).otherwise(F.col("key"))
    mine = keys.select("key", space.alias("bucket"))
    names = written(spaces.select("key_space").distinct(), "spaces").withColumn("known", F.lit(True))
    routed = route_range(mine, ranges)
    routed = routed.join(F.broadcast(names) if names.count() <= MAP_ROWS else names, "key_space", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    known = F.col("known")
    return routed.select(
        "key",
        "key_space",
        F.when(known, "range").otherwise("hash").alias("mode"),
        F.when(known, F.col("partition_id")).otherwise(_home("key_space", pool)).alias("partition_id"),
        F.when(known, F.col("generation")).otherwise(0).alias("generation"),
        (~known | F.col("partition_id").isNotNull()).alias("covered"),
    )


def register_spaces(ranges: DataFrame, spaces: DataFrame) -> DataFrame:
    """The map with one open range for each (key_space, partition_id) that it does not have yet."""
    new = spaces.dropDuplicates(["key_space"]).join(ranges.select("key_space"), "key_space", "left_anti")
    return ranges.unionByName(
        new.select(
            "key_space",
            F.lit(None).cast("string").alias("start_key"),
            F.lit(None).cast("string").alias("end_key"),
            F.col("partition_id").cast("int").alias("partition_id"),
            F.lit(FIRST_GENERATION).cast("long").alias("generation"),
        )
    )


def remove_spaces(ranges: DataFrame, names: DataFrame, quiesced: DataFrame | None = None) -> DataFrame:
    """The map without the named key spaces; those that end in ``/meta`` or have a quiesced range stay."""
    gone = names.where(~F.endswith("key_space", F.lit("/meta")))
    if quiesced is not None:
        gone = gone.join(quiesced.select("key_space"), "key_space", "left_anti")
    return ranges.join(gone.select("key_space"), "key_space", "left_anti").select(*ranges.columns)


def list_spaces(ranges: DataFrame) -> DataFrame:
    """(key_space, ranges, generation): the registered key spaces, with their newest generation."""
    return ranges.groupBy("key_space").agg(F.count("*").alias("ranges"), F.max("generation").alias("generation"))


def child_counts(counts: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """The write counts above 0 of keys in [start, end), as a split's child takes them over."""
    out = counts.where("n > 0")
    if start is not None:
        out = out.where(F.col("key") >= start)
    return out if end is None else out.where(F.col("key") < end)
