"""Operations that depend on all earlier ones of their key: conditional writes, leases, sequences.

A fold partitions by key, sorts by key and order, and streams the rows through
one small state for each key; the state lives on across batches, so that a key
with very many operations needs no more memory than any other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .. import schemas


#: The largest 64-bit value, where a sequence without a maximum ends.
LAST = 2**63 - 1


def fold(ops: DataFrame, key: str, order: list[str], begin: Callable[[], dict], step: Callable[[dict, dict], tuple], schema: str) -> DataFrame:
    """``step(state, row)`` returns the result's columns after the key and may change the state."""
    return ops.repartition(key).sortWithinPartitions(key, *order).mapInPandas(kernel(key, lambda row: begin(), step, schema), schema)


def kernel(key: str, begin: Callable[[dict], dict], step: Callable[[dict, dict], tuple], schema: str) -> Callable:
    """Streams rows that are sorted by key; ``begin(row)`` is the state before a key's first row."""
    names = [c.split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, None
        for batch in batches:
            out = []
            names_in = list(batch.columns)
            columns = [c.tolist() if c.notna().all() else c.astype(object).where(c.notna(), None).tolist() for _, c in batch.items()]
            for values in zip(*columns, strict=True):
                row = dict(zip(names_in, values, strict=True))
                if state is None or row[key] != at:
                    at, state = row[key], begin(row)
                out.append((at, *step(state, row)))
            yield pd.DataFrame(out, columns=names, dtype=object)  # whole numbers beside nulls stay whole

    return run


def new_entry() -> dict:
    return {"revision": -1, "value": None, "expires": None, "state": None, "ts": None}


def mutate(e: dict, m: dict) -> tuple:
    """One SET, DELETE or EXTEND; returns (seq, op, status, revision, value, ts_l, expires_l, state)."""
    now, ttl = int(m["ts_l"]), int(m["ttl_ms"] or 0)
    there = e["state"] == "Set" and (e["expires"] is None or e["expires"] >= now)

    def result(status: str) -> tuple:
        return int(m["seq"]), m["op"], status, e["revision"], e["value"], e["ts"], e["expires"], e["state"]

    if not m["key"] or ttl < 0:
        return result("InvalidInput")
    if m["op"] == "SET":
        refused = (
            (m["nx"] and there)
            or (m["xx"] and not there)
            # neither asks whether the key exists: one that does not has no value, and revision -1 or that of its end
            or (m["cmp_value"] is not None and ((there and e["value"]) or "") != m["cmp_value"])
            or (m["cmp_rev"] is not None and e["revision"] != int(m["cmp_rev"]))
        )
        if refused:
            return result("NotSet")
        e.update(revision=e["revision"] + 1, value=m["value"], ts=now, state="Set", expires=now + ttl if ttl > 0 else None)
        return result("Set")
    if not there:
        return result("DoesNotExist")
    if m["op"] == "DELETE":
        e.update(revision=e["revision"] + 1, value=None, ts=now, state="Deleted", expires=None)
        return result("Deleted")
    e.update(expires=now + ttl if ttl > 0 else None)
    return result("Extended")


def apply_mutations(ops: DataFrame) -> DataFrame:
    """The outcome of each mutation, in the order of its key's (ts_l, seq)."""
    return fold(ops, "key", ["ts_l", "seq"], new_entry, mutate, schemas.MUTATION_RESULT)


def to_log(results: DataFrame, mutations: DataFrame) -> DataFrame:
    """The revision log that accepted mutations leave; a revision that a NOREV write replaced is not archived."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    kept = results.where("status in ('Set', 'Deleted')").join(mutations.select("key", "seq", "norev"), ["key", "seq"])
    after = F.lead("norev").over(Window.partitionBy("key").orderBy("revision"))
    return kept.withColumn("replaced", F.coalesce(after, F.lit(False))).where("not replaced").select(
        "key", "revision", "value", "ts_l", "expires_l", "state", F.col("norev").alias("no_revision")
    )


def new_lock() -> dict:
    return {"owner": None, "expires": None, "token": -1}


def lease(k: dict, o: dict) -> tuple:
    """One lock, extend, unlock or get; returns (seq, op, owner, status, token, expires_l)."""
    now, ttl = int(o["ts_l"]), int(o["ttl_ms"] or 0)
    held = k["owner"] is not None and k["expires"] >= now

    def result(status: str) -> tuple:
        return int(o["seq"]), o["op"], o["owner"], status, k["token"], k["expires"]

    if o["op"] == "lock":
        if held:
            return result("Locked" if k["owner"] == o["owner"] else "Busy")
        k.update(owner=o["owner"], expires=now + ttl, token=k["token"] + 1)
        return result("Locked")
    if o["op"] == "unlock":  # an expired lease can still be given back by its owner
        if k["owner"] is None:
            return result("DoesNotExist")
        if k["owner"] != o["owner"]:
            return result("InvalidOwner")
        k.update(owner=None, expires=None)
        return result("Unlocked")
    if not held:
        return result("DoesNotExist")
    if o["op"] == "get":
        return result("Got")
    if k["owner"] != o["owner"]:
        return result("InvalidOwner")
    k.update(expires=now + ttl)
    return result("Extended")


def apply_leases(ops: DataFrame) -> DataFrame:
    return fold(ops, "resource", ["ts_l", "seq"], new_lock, lease, schemas.LOCK_RESULT)


def allocate(ops: DataFrame, initial: int = 0, increment: int = 1, maximum: int | None = None, block: int = 1) -> DataFrame:
    """Contiguous runs of sequence values; a run is never split, so the rest of a block may be left out.

    A long sequence is cut into parts, each of them one task's work.
    """
    from . import sequences

    if increment <= 0 or (maximum is not None and maximum < initial):
        raise ValueError("the increment is positive and the maximum no less than the initial value")

    def step(s: dict, r: dict) -> tuple:
        seq, n, key = int(r["seq"]), int(r["count"]), r["idempotency_key"]
        if n <= 0:
            return seq, "InvalidInput", None, None, s["reserved"]
        if r.get("copied"):  # of an allocation in an earlier part, which fills it in
            return seq, "Copied", None, None, s["reserved"]
        if key is not None and key in s["seen"]:
            first, last, count = s["seen"][key]
            return (seq, "Allocated", first, last, s["reserved"]) if count == n else (seq, "InvalidInput", None, None, s["reserved"])
        current, reserved = s["current"], s["reserved"]
        if current + increment * n > reserved:
            current, ceiling = reserved, reserved + max(block, n) * increment
            limit = LAST if maximum is None else maximum
            if current + increment * n > limit:
                return seq, "MaxValueExceeded", None, None, s["reserved"]
            if ceiling > limit:  # the last whole step
                ceiling = current + increment * ((limit - current) // increment)
            reserved = ceiling
        first, last = current + increment, current + increment * n
        s.update(current=last, reserved=reserved)
        if key is not None:
            s["seen"][key] = (first, last, n)
        return seq, "Allocated", first, last, reserved

    return sequences.in_parts(ops, step, initial, increment, LAST if maximum is None else maximum, block)


def sequence_records(results: DataFrame) -> DataFrame:
    """(name, current, reserved): what a sequence's record holds after these allocations."""
    from pyspark.sql import functions as F

    return results.where("status = 'Allocated'").groupBy("name").agg(F.max("last").alias("current"), F.max("reserved").alias("reserved"))


def get_sequences(records: DataFrame, names: DataFrame) -> DataFrame:
    """(name, status, current, reserved) for each name: Got or NotFound."""
    from pyspark.sql import functions as F

    out = names.select("name").join(records, "name", "left")
    return out.select("name", F.when(F.col("current").isNotNull(), "Got").otherwise("NotFound").alias("status"), "current", "reserved")


def delete_sequences(records: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(name, status) for each name, Deleted or NotFound, and the records that are left."""
    from pyspark.sql import functions as F

    there = records.select("name", F.lit(True).alias("there"))
    out = names.select("name").join(there, "name", "left").select("name", F.when(F.col("there"), "Deleted").otherwise("NotFound").alias("status"))
    return out, records.join(names.select("name"), "name", "left_anti")
