"""Allocation over sequences of any length: parts of a sequence as tasks of their own.

A part's first pass says what it makes of every state that it may begin with; put
together in order, these give each part's own beginning, from which the second pass
folds it.  The state is how much of a block is left, less than ``block`` steps, and
where the block ends.  Of rows with one idempotency key the first alone takes values,
in whatever part it stands.  Near the maximum it is not so, as the first may be refused
and a later one not: from there on parts are folded one after another, but only those
that have a request small enough for what is left.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from . import folds

#: Requests of one sequence that are one task's work, but for those of equal ``seq``.
PART_ROWS = 500_000

_ORDER = ("seq", "count", "idempotency_key")
_PIECES = "root INT, part INT, low DECIMAL(38), left DECIMAL(38), taken DECIMAL(38)"
_ENTRIES = "root INT, part INT, left DECIMAL(38), taken DECIMAL(38)"


def last_at_most(bounds, value, longest: int):
    """How many elements of the sorted array, of at most ``longest``, are at most ``value``, by halving."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(longest.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(bounds, at + s - 1) <= value, at + s).otherwise(at)) if longest else F.lit(0)


def pieces(block: int) -> Callable:
    """What each part makes of a state: from ``low`` steps left on, ``left`` at its end and the steps reserved in it.

    Where nothing is reserved, what is left is less by the part's whole count,
    which is ``low``.
    """

    def one(root: int, part: int, n: np.ndarray) -> list[tuple]:
        if n.sum(dtype=float) > 2**61 or block > 2**61:
            n = n.astype(object)
        end = np.concatenate([n[:0], [0], np.cumsum(n)])
        size = np.maximum(n, block)
        after = (np.searchsorted(end, end[:-1] + size, side="right") - 1).tolist()
        known = {len(n): (0, 0)}
        out = []
        for i in range(int(np.searchsorted(end, block, side="left"))):
            path, at = [], i
            while at not in known:
                path.append(at)
                at = after[at]
            for j in reversed(path):
                left, taken = known[after[j]]
                if after[j] == len(n):
                    left = int(size[j]) - int(end[-1] - end[j])
                known[j] = (left, taken + int(size[j]))
            out.append((root, part, *map(Decimal, (int(end[i]), *known[i]))))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _PIECES.split(", ")]
        at, held = None, []
        for batch in batches:
            for (root, part), rows in batch.groupby(["root", "part"], sort=True):
                if at is not None and at != (root, part):
                    yield pd.DataFrame(one(*at, np.concatenate(held)), columns=names)
                    held = []
                at = (root, part)
                held.append(rows["count"].to_numpy())
        if at is not None:
            yield pd.DataFrame(one(*at, np.concatenate(held)), columns=names)

    return run


def in_parts(ops: DataFrame, step: Callable, initial: int, increment: int, limit: int, block: int) -> DataFrame:
    """``step`` over the requests of each sequence in order."""
    spark = ops.sparkSession
    ops = ops.select("name", *_ORDER)

    def begin(row: dict | None = None, at: dict | None = None) -> dict:
        current, reserved = (at or {}).get(row and row.get("part"), (initial, initial))
        return {"current": current, "reserved": reserved, "seen": {}}

    sizes = ops.groupBy("name").agg(F.count("*").alias("n"), F.count("idempotency_key").alias("keyed"))
    long = F.col("n") > PART_ROWS
    sizes = sizes.agg(F.coalesce(F.sum(F.when(~long, F.col("n"))), F.lit(0)).alias("rest"), F.collect_list(F.when(long, F.struct("name", "n", "keyed"))).alias("long")).first()
    if not sizes["long"]:
        return folds.fold(ops, "name", list(_ORDER), begin, step, schemas.SEQUENCE_RESULT)

    # cuts of the long sequences; a root is the number of a sequence's first part
    most = max(-(-r["n"] // PART_ROWS) for r in sizes["long"])
    fine = 8 * most
    names = spark.createDataFrame([(r["name"], i) for i, r in enumerate(sizes["long"])], "__name string, __i int")
    grid = F.percentile_approx("seq", [i / fine for i in range(1, fine)], max(10_000, 10 * fine))
    found = ops.join(F.broadcast(names), F.col("name").eqNullSafe(F.col("__name"))).groupBy("__i").agg(grid.alias("grid")).collect()
    found = {r["__i"]: r["grid"] for r in found}
    roots, n_parts = [], 0
    for i, r in enumerate(sizes["long"]):
        own = -(-r["n"] // PART_ROWS)
        cuts = sorted({found[i][round(j * fine / own) - 1] for j in range(1, own)})
        roots.append((r["name"], n_parts, cuts))
        n_parts += len(cuts) + 1
    rest = max(1, -(-sizes["rest"] // PART_ROWS))
    tasks = n_parts + rest
    cut = spark.createDataFrame(roots, "__name string, root int, cuts array<bigint>")
    placed = ops.join(F.broadcast(cut), F.col("name").eqNullSafe(F.col("__name")), "left").withColumn(
        "part", F.coalesce(F.col("root") + last_at_most(F.col("cuts"), F.col("seq"), most), F.lit(n_parts) + F.pmod(F.xxhash64("name"), F.lit(rest)).cast("int"))
    ).drop("__name", "cuts")
    keyed = any(r["keyed"] for r in sizes["long"])

    # what is larger than the whole sequence is refused in every state
    fits = (F.col("count") > 0) & (F.col("count") <= min((limit - initial) // increment, folds.LAST))
    takers = placed.where(F.col("root").isNotNull() & F.col("idempotency_key").isNull() & fits).select("root", "part", "seq", "count")
    with_key = placed.where(F.col("root").isNotNull() & F.col("idempotency_key").isNotNull()).repartition(tasks, "root", "idempotency_key")
    if keyed:
        led = with_key.where(fits).groupBy("root", "idempotency_key").agg(F.min(F.struct("seq", "count", "part")).alias("l"))
        takers = takers.unionByName(led.select("root", "l.part", "l.seq", "l.count"))
    if block == 1:
        made = takers.groupBy("root", "part").agg(F.sum(F.col("count").cast("decimal(38,0)")).cast("decimal(38,0)").alias("taken"))
        made = made.selectExpr("root", "part", "cast(0 as decimal(38,0)) as low", "cast(0 as decimal(38,0)) as left", "taken")
    else:
        made = takers.repartitionById(n_parts, F.col("part")).sortWithinPartitions("part", "seq", "count").mapInPandas(pieces(block), _PIECES)

    zero = Decimal(0)  # a part without a request that takes values changes nothing
    every = [(root, root + i, zero, zero, zero) for _, root, cuts in roots for i in range(len(cuts) + 1)]
    made = made.unionByName(spark.createDataFrame(every, _PIECES))

    def entry(s: dict, r: dict) -> tuple:
        if s["part"] != r["part"]:
            s.update(part=r["part"], left=s["next"][0], taken=s["next"][1])
        low, taken = int(r["low"]), int(r["taken"])
        if low <= s["left"]:
            s["next"] = (int(r["left"]) if taken else s["left"] - low, s["taken"] + taken)
        return int(r["part"]), Decimal(s["left"]), Decimal(s["taken"])

    entries = folds.fold(made, "root", ["part", "low", "taken"], lambda: {"part": None, "next": (0, 0)}, entry, _ENTRIES).distinct().collect()
    by_root: dict[int, list] = {}
    for r in sorted(entries, key=lambda r: r["part"]):
        reserved = initial + int(r["taken"]) * increment
        by_root.setdefault(r["root"], []).append((r["part"], reserved - int(r["left"]) * increment, reserved))

    starts: dict[int, tuple] = {}
    open_: dict[int, int] = {}  # parts that may be refused values and have others after them, and where their sequences end
    late: list[int] = []
    for (_, root, cuts) in roots:
        known, end = by_root[root], root + len(cuts) + 1
        for at, (part, current, reserved) in enumerate(known):
            starts[part] = (current, reserved)
            if at + 1 < len(known) and known[at + 1][2] > limit:
                open_[part] = end
                late += range(part, end)
                break

    def prepared(grown: DataFrame | None) -> DataFrame:
        """The requests, with whether a key's values were taken in an earlier part."""
        plain = placed if not keyed else placed.where("root is null or idempotency_key is null")
        plain = plain.withColumn("copied", F.lit(False))
        if not keyed:
            return plain
        same = Window.partitionBy("root", "idempotency_key")
        rows = with_key.withColumn("owner", F.min(F.when(fits, F.struct("seq", "count", "part"))).over(same)["part"])
        if late:
            lost = spark.createDataFrame([(p, True) for p in late], "owner int, lost boolean")
            rows = rows.join(F.broadcast(lost), "owner", "left").withColumn("owner", F.when(F.col("lost").isNull(), F.col("owner"))).drop("lost")
        if grown is not None:
            rows = rows.join(grown, ["root", "idempotency_key"], "left").withColumn("owner", F.coalesce("owner", "grown")).drop("grown")
        return plain.unionByName(rows.withColumn("copied", F.coalesce(F.col("owner") < F.col("part"), F.lit(False))).drop("owner"))

    more = "root INT, part INT, idempotency_key STRING, count BIGINT, copied BOOLEAN"

    def folded(rows: DataFrame, wide: bool) -> DataFrame:
        def full(s: dict, r: dict) -> tuple:
            return (*step(s, r), r["root"] if r["root"] is None else int(r["root"]), r["part"], r["idempotency_key"], r["count"], r["copied"])

        at = dict(starts)
        schema = schemas.SEQUENCE_RESULT + (f", {more}" if wide else "")
        run = folds.kernel("name", lambda row: begin(row, at), full if wide else step, schema)
        return rows.repartitionById(tasks, F.col("part")).sortWithinPartitions("name", *_ORDER).mapInPandas(run, schema)

    # beyond the first refusal, parts one after another
    grown, least = None, None
    while open_:
        from ..sources.storage import written

        now = written(folded(prepared(grown).where(F.col("part").isin(list(open_))), True).where("status = 'Allocated' and not copied"), "sequence")
        ends = {r["part"]: r for r in now.groupBy("part").agg(F.max("last").alias("last"), F.max("reserved").alias("reserved")).collect()}
        if keyed:
            new = now.where("idempotency_key is not null").select("root", "idempotency_key", F.col("part").alias("grown")).distinct()
            grown = new if grown is None else grown.unionByName(new)
        after = {}
        for part, end in open_.items():
            current, reserved = (ends[part]["last"], ends[part]["reserved"]) if part in ends else starts[part]
            room = max(reserved - current, limit - reserved) // increment
            if room and least is None:
                least = {r["part"]: r["n"] for r in placed.where(F.col("part").isin(late) & fits).groupBy("part").agg(F.min("count").alias("n")).collect()}
            for p in range(part + 1, end):
                starts[p] = (current, reserved)
                if room and p in least and least[p] <= room:
                    after[p] = end
                    break
        open_ = after

    if not keyed:
        return folded(prepared(None), False)
    same = Window.partitionBy("root", "name", "idempotency_key", "__own")
    out = folded(prepared(grown), True).withColumn("__own", F.when(F.col("root").isNull() | F.col("idempotency_key").isNull(), F.struct("name", "seq")))
    out = out.repartition(tasks, "root", "name", "idempotency_key", "__own")
    first = F.min(F.when(F.expr("status = 'Allocated' and not copied"), F.struct("first", "last", "count"))).over(same)
    out = out.withColumn("__first", first)
    again = F.col("__first.count") == F.col("count")
    copied = F.col("status") == "Copied"
    return out.select(
        "name",
        "seq",
        F.when(copied, F.when(again, "Allocated").otherwise("InvalidInput")).otherwise(F.col("status")).alias("status"),
        *[F.when(copied & again, F.col(f"__first.{c}")).when(~copied, F.col(c)).alias(c) for c in ("first", "last")],
        "reserved",
    )
