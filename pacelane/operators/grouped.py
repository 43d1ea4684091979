"""Grouped Arrow kernels whose tasks stay spread over the cluster."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

Kernel = Callable[[tuple, pa.Table], Mapping[str, Sequence]]
HELD = 10_000
"""Result rows that a task holds before it hands them on."""


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Shuffle by key into the configured number of partitions.

    Adaptive execution merges small shuffle partitions by bytes; a kernel that
    spends much time on few bytes needs its tasks kept apart.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _cuts(batch: pa.RecordBatch, keys: Sequence[str]) -> np.ndarray:
    """Places of a sorted batch where a key differs from that of the row before; a null is a key like any other."""
    differs = np.zeros(batch.num_rows - 1, dtype=bool)
    for k in keys:
        column = batch.column(k)
        a, b = column.slice(0, batch.num_rows - 1), column.slice(1)
        differs |= pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        if column.null_count:
            differs |= pc.xor(a.is_null(), b.is_null()).to_numpy(zero_copy_only=False)
    return np.flatnonzero(differs) + 1


def _groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Key and rows of each group of a task's sorted rows; a group may reach over many batches."""
    held: list[pa.RecordBatch] = []
    key: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        bounds = [0, *_cuts(batch, keys).tolist(), batch.num_rows]
        heads = list(zip(*[batch.column(k).take(pa.array(bounds[:-1])).to_pylist() for k in keys], strict=True))
        for head, start, stop in zip(heads, bounds, bounds[1:]):
            if held and head != key:
                yield key, pa.Table.from_batches(held)
                held = []
            key = head
            held.append(batch.slice(start, stop - start))
    if held:
        yield key, pa.Table.from_batches(held)


def _joined(parts: list, kind: pa.DataType) -> pa.Array:
    """One array of the values that several groups gave."""
    if all(isinstance(p, list) for p in parts):
        return pa.array(list(chain.from_iterable(parts)), kind)
    return pa.concat_arrays([pa.array(p, kind) for p in parts])


def apply_grouped(df: DataFrame, keys: Sequence[str], kernel: Kernel, schema: T.StructType) -> DataFrame:
    """Run a kernel per group; it gets the key values and the group's columns and returns columns.

    A task takes its groups one after another from sorted rows, so many short series
    cost a call of the kernel each, not an Arrow stream each.
    """
    arrow, keys = to_arrow_schema(schema), list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: dict[str, list] = {f.name: [] for f in arrow}
        rows = 0

        def hand_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([_joined(done[f.name], f.type) for f in arrow], schema=arrow)
            for parts in done.values():
                parts.clear()
            return out

        for key, table in _groups(batches, keys):
            columns = kernel(key, table)
            for name, parts in done.items():
                parts.append(columns[name])
            rows += len(columns[arrow.names[0]])
            if rows >= HELD:
                yield hand_on()
                rows = 0
        if rows:
            yield hand_on()

    return spread(df, *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def sorted_columns(table: pa.Table, by: str, *names: str):
    """NumPy columns of a group in the order of one of them."""
    order = table.column(by).to_numpy().argsort(kind="stable")
    return tuple(table.column(n).to_numpy()[order] for n in (by, *names))
