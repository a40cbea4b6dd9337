"""The folds over a stream: one state for each key, kept by Structured Streaming."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .. import schemas
from ..operators import folds


def stream_fold(ops: DataFrame, key: str, order: list[str], begin: Callable[[], dict], step: Callable[[dict, dict], tuple], schema: str) -> DataFrame:
    """As ``operators.folds.fold``, for a streaming frame; operations of a micro-batch are taken in order."""
    names = [c.split()[0] for c in schema.split(",")]

    def run(group: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = json.loads(state.get[0]) if state.exists else begin()
        rows = pd.concat(list(batches)).sort_values(order)
        out = [(group[0], *step(now, row)) for row in rows.astype(object).where(rows.notna(), None).to_dict("records")]
        state.update((json.dumps(now),))
        yield pd.DataFrame(out, columns=names)

    return ops.groupBy(key).applyInPandasWithState(run, schema, "state STRING", "append", "NoTimeout")


def mutations(ops: DataFrame) -> DataFrame:
    return stream_fold(ops, "key", ["ts_l", "seq"], folds.new_entry, folds.mutate, schemas.MUTATION_RESULT)


def leases(ops: DataFrame) -> DataFrame:
    return stream_fold(ops, "resource", ["ts_l", "seq"], folds.new_lock, folds.lease, schemas.LOCK_RESULT)
