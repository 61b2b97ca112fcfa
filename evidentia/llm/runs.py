"""Work on all rows of a key without a pandas frame per key.

Rows are dealt and sorted by key; a task walks through its sorted rows and gets
the rows of one key, or of many small keys at once, as Arrow tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .kernel import trim


def key_changes(keys: np.ndarray) -> np.ndarray:
    """Places where a new key begins, then the number of rows."""
    if not len(keys):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


def whole_keys(batches: Iterator[pa.RecordBatch], key: str, most: int | None = None) -> Iterator[tuple[pa.Table, bool]]:
    """Tables that hold whole keys: the last key of a batch waits for the next batch.

    With ``most``, a waiting key of more rows is not kept: it comes in pieces, marked True.
    """
    kept: list[pa.RecordBatch] = []
    hot = None
    for batch in batches:
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        if hot is not None:
            more = int(np.searchsorted(keys, hot, "right"))
            if more:
                yield pa.Table.from_batches([batch.slice(0, more)]), True
            batch, keys = batch.slice(more), keys[more:]
        if not len(keys):
            continue
        hot = None
        if kept and kept[-1].column(key)[0].as_py() == keys[-1]:
            kept.append(batch)
        else:
            cut = int(np.searchsorted(keys, keys[-1], "left"))
            done = [*kept, batch.slice(0, cut)] if cut else kept
            if done:
                yield pa.Table.from_batches(done), False
            kept = [batch.slice(cut)]
        if most is not None and sum(b.num_rows for b in kept) > most:
            yield pa.Table.from_batches(kept), True
            kept, hot = [], keys[-1]
    if kept:
        yield pa.Table.from_batches(kept), False


def by_sorted_key(df: DataFrame, key: str, order: list[str], work: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str, parts: int | None = None, most: int | None = None, hot: Callable[[pa.Table], Iterator[pa.RecordBatch]] | None = None, prepare: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None) -> DataFrame:
    """work() gets tables of whole keys in ascending order of the (non-null integer) key; hot() gets pieces of a key of more than ``most`` rows.

    prepare() turns the sorted batches into others that are sorted by the key too.
    """
    dealt = df.repartition(parts, key) if parts else df.repartition(key)

    def run(batches):
        for table, piece in whole_keys(prepare(batches) if prepare else batches, key, most):
            yield from (hot if piece else work)(table)
        trim()

    return dealt.sortWithinPartitions(key, *order).mapInArrow(run, schema)
