"""Low-pass filtering of long series, cut into chunks that hand their filter state on."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pacelane.functions.filters import low_pass
from pacelane.operators import ordered
from pacelane.operators.grouped import apply_grouped, sorted_columns
from pacelane.session import settle

CAUSAL, ZERO_PHASE = "causal", "zero_phase"
PADDINGS = ("odd", "even", "constant", "none")


def _pass(df: DataFrame, keys: list[str], design: tuple[int, float, float], settled: bool, chunk: int) -> DataFrame:
    """One filter pass in the order of ``i`` over ``x``; replaces ``x`` by the filtered value.

    Each chunk is filtered from rest to learn the state it adds; a walk over these
    small states gives every chunk the state it starts in; then chunks are filtered.
    """
    fields = [df.schema[k] for k in keys]
    vector, long = T.ArrayType(T.DoubleType()), T.LongType()
    cut = settle(ordered.with_chunk(df, "i", chunk))
    end_schema = T.StructType([*fields, T.StructField("c", long), T.StructField("n", long), T.StructField("x0", T.DoubleType()), T.StructField("state", vector)])
    start_schema = T.StructType([*fields, T.StructField(ordered.CHUNK, long), T.StructField("state", vector)])
    rows_schema = T.StructType([*fields, T.StructField("i", long), T.StructField("x", T.DoubleType())])

    def repeat(key, count):
        return {k: [v] * count for k, v in zip(keys, key)}

    def ends(key, table):
        _, x = sorted_columns(table, "i", "x")
        f = low_pass(*design)
        _, state = f.run(x, np.zeros(f.size))
        return repeat(key, 1) | {"c": [key[-1]], "n": [len(x)], "x0": [float(x[0])], "state": [state.tolist()]}

    def walk(key, table):
        f = low_pass(*design)
        state, chunks, states = None, [], []
        for row in sorted(table.select(["c", "n", "x0", "state"]).to_pylist(), key=lambda r: r["c"]):
            if state is None:
                state = f.settled * row["x0"] if settled else np.zeros(f.size)
            chunks.append(row["c"])
            states.append(state.tolist())
            state = f.coast(state, row["n"]) + np.asarray(row["state"])
        return repeat(key, len(chunks)) | {ordered.CHUNK: chunks, "state": states}

    def apply(key, table):
        i, x = sorted_columns(table, "i", "x")
        y, _ = low_pass(*design).run(x, np.asarray(table.column("state")[0].as_py()))
        return repeat(key, len(y)) | {"i": i, "x": y}

    starts = apply_grouped(apply_grouped(cut, [*keys, ordered.CHUNK], ends, end_schema), keys, walk, start_schema)
    return apply_grouped(cut.join(starts, [*keys, ordered.CHUNK]), [*keys, ordered.CHUNK], apply, rows_schema)


def lowpass(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    value: str,
    out: str,
    *,
    order: int,
    cutoff_hz: float,
    rate_hz: float,
    phase: str = ZERO_PHASE,
    padding: str = "odd",
    pad_length: int | None = None,
    chunk: int = 100_000,
) -> DataFrame:
    """Filtered series per key (a stream and its contiguous segment).

    Values must be finite.  A zero-phase series no longer than its padding cannot
    be filtered and gets NULL.
    """
    if padding not in PADDINGS:
        raise ValueError(f"unknown padding {padding!r}")
    keys, design = list(keys), (int(order), float(cutoff_hz), float(rate_hz))
    f = low_pass(*design)
    rows = settle(ordered.number(df, keys, order_by, "i", chunk=chunk))
    series = rows.select(*keys, "i", F.col(value).cast("double").alias("x"))
    if phase == CAUSAL:
        done = _pass(series, keys, design, False, chunk)
        return rows.join(done.withColumnRenamed("x", out), [*keys, "i"]).drop("i")

    pad = 0 if padding == "none" else f.pad_length if pad_length is None else pad_length
    ends = series.groupBy(*keys).agg(F.max("i").alias("__n"), F.min_by("x", "i").alias("__a"), F.max_by("x", "i").alias("__b"))
    long_enough = ordered.attach(series, ends.filter(F.col("__n") + 1 > pad), keys, "i")
    shape = {"odd": lambda edge: 2 * edge - F.col("x"), "even": lambda edge: F.col("x"), "constant": lambda edge: edge, "none": lambda edge: edge}[padding]
    whole = long_enough.select(*keys, "i", "x")
    if pad:
        left = long_enough.filter(F.col("i").between(1, pad)).select(*keys, (-F.col("i")).alias("i"), shape(F.col("__a")).alias("x"))
        right = long_enough.filter(F.col("i").between(F.col("__n") - pad, F.col("__n") - 1)).select(*keys, (2 * F.col("__n") - F.col("i")).alias("i"), shape(F.col("__b")).alias("x"))
        whole = whole.unionByName(left).unionByName(right)
    forward = _pass(whole, keys, design, True, chunk)
    backward = _pass(forward.withColumn("i", -F.col("i")), keys, design, True, chunk)
    done = backward.select(*keys, (-F.col("i")).alias("i"), F.col("x").alias(out))
    return rows.join(done, [*keys, "i"], "left").drop("i")
