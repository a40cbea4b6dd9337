"""Mixing sources to target weights by entropy balancing.

Each source has a target of words.  Among all document rates ``0 < r <= cap``
that meet the targets, the ones closest to 1 in relative entropy are
``r = min(cap, exp(lambda_s * x))`` with ``x`` the document's size over its
source's mean size: exponential tilting, one dual variable for each source's
token constraint.  The dual is convex; its gradient and its curvature are sums
over (source, size) counts, aggregated by Spark, and Newton steps, held inside
a bracket, solve it for all sources at once.

The rates become copies: ``floor(r)``, and one more where a hash of the doc_id,
less the fraction, lies under the source's bar.  The bar is found from word
counts over 4096 bins and again within the bin it falls in, so the words taken
meet the target to about one document.  Nothing depends on the order of rows.

Edge cases: null texts have size 0; a null source is a source, the last one;
documents of size 0 are copied once and take no words; a source without words
has target 0; rows that share a doc_id share their draw; other columns pass
through in ``mix`` (its own replace those of the same name); an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, spill, words

BINS = 1 << 12
_SOLVED = 1e-10


def size_of(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, size) rows.

    Sources by code point, null last, have the weights in turn; together they
    are to have ``share`` times all words.  No target exceeds ``cap`` times its
    source's words; what is above is shared again by weight.
    """
    if share > cap:
        raise ValueError("the targets can't be met: share exceeds cap")
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    by = by.withColumn("place", place).withColumn("weight", weight).withColumn("room", cap * F.col("source_size"))
    # water level: sources are full in the order of room per weight; the level is the first that leaves the next below
    order = Window.orderBy((F.col("room") / F.col("weight")), "place")
    filled = F.coalesce(F.sum("room").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    still = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    everything = F.sum("source_size").over(Window.partitionBy())
    level = (share * everything - filled) / still
    by = by.withColumn("level", level)
    open_ = F.col("level") <= F.col("room") / F.col("weight")
    final = F.min_by(F.when(open_, F.col("level")), F.when(open_, F.struct(F.col("room") / F.col("weight"), F.col("place")))).over(
        Window.partitionBy()
    )
    return by.withColumn("final", final).select(
        "source",
        "source_size",
        F.least("room", F.coalesce(F.col("final") * F.col("weight"), F.col("room"))).alias("target"),
    )


def _rate(lam: Column, x: Column, cap: float) -> Column:
    import math

    return F.when(lam * x >= math.log(cap), F.lit(float(cap))).otherwise(F.exp(lam * x))


def dual(sizes: DataFrame, goal: DataFrame, cap: float = 2.0, rounds: int = 60) -> DataFrame:
    """(source, source_size, target, mean, lam): ``lam`` solves each source's token constraint."""
    import math

    counts = spill(sizes.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")), "sizes")
    mean = counts.groupBy("source").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean"))
    state = goal.join(mean.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    top = 1e6
    state = state.select(
        "source", "source_size", "target", F.coalesce("mean", F.lit(1.0)).alias("mean"),
        F.when(F.col("source_size") == 0, 0.0)
        .when(F.col("target") >= cap * F.col("source_size") * (1 - 1e-12), F.lit(top))
        .when(F.col("target") <= 0, F.lit(-top))
        .otherwise(F.log(F.col("target") / F.col("source_size"))).alias("lam"),
        F.lit(-top).alias("low"), F.lit(top).alias("high"), F.lit(False).alias("done"),
    ).withColumn("done", (F.abs("lam") >= top) | (F.col("source_size") == 0))
    state = spill(state, "dual")
    for _ in range(rounds):
        here = small(state.where("not done").select(F.col("source").alias("s"), "lam", "mean"))
        x = F.col("size") / F.col("mean")
        bent = counts.join(here, F.col("source").eqNullSafe(F.col("s")))
        sums = bent.groupBy("s").agg(
            F.sum(F.col("n") * F.col("size") * _rate(F.col("lam"), x, cap)).alias("words"),
            F.sum(F.when(F.col("lam") * x < math.log(cap), F.col("n") * F.col("size") * x * F.exp(F.col("lam") * x)).otherwise(0.0)).alias("slope"),
        )
        step = state.join(sums, F.col("source").eqNullSafe(F.col("s")) & ~F.col("done"), "left")
        gap = F.col("words") - F.col("target")
        low = F.when(gap < 0, F.col("lam")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("lam")).otherwise(F.col("high"))
        step = step.withColumns({"gap": gap, "low2": low, "high2": high})
        newton = F.when(F.col("slope") > 0, F.col("lam") - F.col("gap") / F.col("slope"))
        inside = (newton > F.col("low2")) & (newton < F.col("high2"))
        # a bracket with an open end grows geometrically before it is halved
        middle = (
            F.when((F.col("gap") > 0) & (F.col("low2") <= -top), F.least(2 * F.col("lam"), F.col("lam") - 1))
            .when((F.col("gap") < 0) & (F.col("high2") >= top), F.greatest(2 * F.col("lam"), F.col("lam") + 1))
            .otherwise((F.col("low2") + F.col("high2")) / 2)
        )
        met = F.coalesce(F.abs("gap") <= _SOLVED * F.col("target"), F.lit(True))
        state = spill(
            step.select(
                "source", "source_size", "target", "mean",
                F.when(F.col("done") | met, F.col("lam")).when(F.coalesce(inside, F.lit(False)), newton).otherwise(middle).alias("lam"),
                F.coalesce("low2", "low").alias("low"), F.coalesce("high2", "high").alias("high"),
                (F.col("done") | met).alias("done"),
            ),
            "dual",
        )
        if state.where("not done").isEmpty():
            break
    return state.select("source", "source_size", "target", "mean", "lam")


def _drawn(rows: DataFrame, cap: float, seed: int) -> DataFrame:
    """Adds rate, whole (copies for certain) and at (hash less fraction, 0 to 2; null if no copy can be added)."""
    x = F.col("size") / F.col("mean")
    u = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    rows = rows.withColumn("rate", F.when(F.col("size") == 0, 1.0).otherwise(_rate(F.col("lam"), x, cap)))
    rows = rows.withColumn("whole", F.floor("rate").cast("long"))
    extra = (F.col("whole") + 1 <= cap) & (F.col("size") > 0)
    return rows.withColumn("at", F.when(extra, u - (F.col("rate") - F.col("whole")) + 1))


def _bars(drawn: DataFrame) -> DataFrame:
    """(source, bar): one more copy goes to documents whose ``at`` lies under the bar."""

    def cut(parts: DataFrame) -> DataFrame:
        """The bin in which the words reach the goal, and what is still wanted when it begins."""
        run = Window.partitionBy("s").orderBy("bin")
        over = parts.withColumn("before", F.coalesce(F.sum("w").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        return over.where("before < want and before + w >= want").select(
            F.col("s").alias("s1"), F.col("bin").alias("bin1"), (F.col("want") - F.col("before")).alias("want1"), F.col("w").alias("w1")
        )

    fixed = drawn.groupBy(F.col("source").alias("s")).agg(
        (F.first("target") - F.sum(F.col("whole") * F.col("size"))).alias("want")
    )
    fixed = spill(fixed, "wanted")
    key = F.col("s").eqNullSafe(F.col("s0"))
    bins = drawn.where("at is not null").groupBy(F.col("source").alias("s0"), F.floor(F.col("at") * BINS).alias("bin")).agg(F.sum("size").alias("w"))
    coarse = spill(cut(bins.join(fixed, key).drop("s0")), "bar")
    same = F.col("source").eqNullSafe(F.col("s1")) & (F.floor(F.col("at") * BINS) == F.col("bin1"))
    inner = drawn.where("at is not null").join(small(coarse), same)
    fine = inner.groupBy(F.col("source").alias("s"), F.floor((F.col("at") * BINS - F.col("bin1")) * BINS).alias("bin")).agg(
        F.sum("size").alias("w"), F.first("want1").alias("want"), F.first("bin1").alias("outer")
    )
    outer = fine.select(F.col("s").alias("s2"), "outer").distinct()
    found = cut(fine.drop("outer")).join(outer, F.col("s1").eqNullSafe(F.col("s2")))
    # the last bin goes in whole if that comes nearer to the target
    last = F.col("bin1") + F.when(2 * F.col("want1") > F.col("w1"), 1).otherwise(0)
    found = found.select(F.col("s1"), ((F.col("outer") + last / BINS) / BINS).alias("bar"))
    low = F.when(F.col("want") <= 0, F.lit(-1.0)).otherwise(F.lit(3.0))
    return fixed.join(found, F.col("s").eqNullSafe(F.col("s1")), "left").select(
        F.col("s").alias("source"), F.coalesce("bar", low).alias("bar")
    )


def plan(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 7) -> DataFrame:
    """(source, source_size, target, mean, lam, bar) for (doc_id, source, size) rows: all that the copies depend on."""
    goal = spill(targets(sizes, weights, share, cap), "targets")
    solved = dual(sizes, goal, cap)
    drawn = _drawn(_with(sizes, solved), cap, seed)
    bars = _bars(drawn).withColumnRenamed("source", "s")
    out = solved.join(bars, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    return spill(out, "mix")


def _with(rows: DataFrame, solved: DataFrame) -> DataFrame:
    named = small(solved.withColumnRenamed("source", "__s"))
    return rows.join(named, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")


def apply_plan(rows: DataFrame, made: DataFrame, cap: float = 2.0, seed: int = 7) -> DataFrame:
    """(doc_id, source, size, ...) rows with source_size, target, rate, copies and taken."""
    out = _drawn(_with(rows, made), cap, seed)
    copies = F.col("whole") + F.when(F.col("at") < F.col("bar"), 1).otherwise(0)
    return out.withColumn("copies", copies.cast("long")).withColumn("taken", F.col("copies") * F.col("size")).drop(
        "mean", "lam", "bar", "whole", "at"
    )


def mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 7) -> DataFrame:
    """``docs`` with size, source_size, target, rate, copies and taken."""
    own = ("size", "source_size", "target", "rate", "copies", "taken")
    slim = spill(docs.select("doc_id", "source", size_of(F.col("text")).alias("size")), "slim")
    made = plan(slim, weights, share, cap, seed)
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in own])
    rows = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), rest.alias("row"))
    return apply_plan(rows, made, cap, seed).select("row.*", *own)
