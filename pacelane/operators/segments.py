"""Gaps, islands, cadence grids, duplicates and order checks on long series."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pacelane.operators import ordered
from pacelane.operators.grouped import apply_grouped, sorted_columns
from pacelane.session import settle

DEFAULT_CHUNK_NS = 600_000_000_000


def gap_before(window, time: str, max_gap_ns: int | Column) -> Column:
    """True where the step from the previous sample is longer than allowed."""
    return F.coalesce(F.col(time) - F.lag(time).over(window) > max_gap_ns, F.lit(False))


def segment_by_gap(df: DataFrame, keys: Sequence[str], order: Sequence[str], max_gap_ns: int, out: str = "segment_index", *, chunk: int | None = DEFAULT_CHUNK_NS) -> DataFrame:
    """Zero-based segment number; a new segment starts after a long step."""
    marked = ordered.stencil(df, keys, order, lambda w: {"__gap": gap_before(w, order[0], max_gap_ns)}, ahead=0, chunk=chunk)
    return ordered.running(marked, keys, order, chunk=chunk, sums={out: F.col("__gap").cast("bigint")}).drop("__gap")


def mark_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], valid: Column, max_gap_ns: int | None = None, *, chunk: int | None = DEFAULT_CHUNK_NS) -> DataFrame:
    """Adds ``is_valid`` and ``run_no``; valid rows of one run share the number.

    Anything that ends a run (an invalid row, or a long step) adds one, so equal
    numbers on valid rows mean nothing ended in between.
    """
    df = df.withColumn("is_valid", F.coalesce(valid, F.lit(False)))
    ends = ~F.col("is_valid")
    if max_gap_ns is not None:
        df = ordered.stencil(df, keys, order, lambda w: {"__gap": gap_before(w, order[0], max_gap_ns)}, ahead=0, chunk=chunk)
        ends = ends | F.col("__gap")
    out = ordered.running(df, keys, order, chunk=chunk, sums={"run_no": ends.cast("bigint")})
    return out.drop("__gap")


def runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], valid: Column, max_gap_ns: int | None = None, *, chunk: int | None = DEFAULT_CHUNK_NS) -> DataFrame:
    """One row per run of valid samples: first and last time and sample count."""
    marked = mark_runs(df, keys, order, valid, max_gap_ns, chunk=chunk).filter("is_valid")
    return marked.groupBy(*keys, "run_no").agg(F.min(order[0]).alias("start_ns"), F.max(order[0]).alias("end_ns"), F.count(F.lit(1)).alias("samples")).drop("run_no")


def cadence_span(df: DataFrame, keys: Sequence[str], time: str, step_ns: int) -> DataFrame:
    """First and last time per key and how many ticks the cadence expects between them."""
    span = df.groupBy(*keys).agg(F.min(time).alias("first_ns"), F.max(time).alias("last_ns"))
    ticks = F.call_function("div", F.col("last_ns") - F.col("first_ns") + F.lit(step_ns // 2).cast("bigint"), F.lit(step_ns).cast("bigint")) + 1
    return span.withColumn("expected_ticks", ticks)


def off_grid(time: Column, origin: Column, step_ns: int, tolerance_ns: int = 1) -> Column:
    """True for a sample more than the tolerance away from its nearest tick."""
    rest = F.pmod(time - origin, F.lit(step_ns).cast("bigint"))
    return F.least(rest, F.lit(step_ns).cast("bigint") - rest) > tolerance_ns


def coverage_by_grid(df: DataFrame, keys: Sequence[str], time: str, step_ns: int, usable: Column) -> DataFrame:
    """Share of expected ticks with a usable row, and rows that miss the grid.

    No grid is built: ticks are counted from the span, usable ticks from the rows.
    """
    span = cadence_span(df, keys, time, step_ns)
    joined = ordered.attach(df, span, keys, time)
    counted = joined.groupBy(*keys, "first_ns", "last_ns", "expected_ticks").agg(
        F.countDistinct(F.when(usable, F.col(time))).alias("usable_ticks"),
        F.count_if(off_grid(F.col(time), F.col("first_ns"), step_ns)).alias("off_grid_rows"),
    )
    return counted.withColumn("coverage", F.col("usable_ticks") / F.col("expected_ticks"))


def dropout_intervals(
    df: DataFrame, owner: Sequence[str], series: Sequence[str], time: str, step_ns: int, usable: Column, *, chunk: int | None = DEFAULT_CHUNK_NS
) -> DataFrame:
    """Half-open missing intervals of each series on its owner's cadence.

    ``owner`` keys (a subject) fix the observed span; ``series`` keys (a landmark)
    may miss ticks at the start, inside and at the end of it.  A missing stretch
    is the room between two usable rows, so nothing is expanded tick by tick.
    """
    keys = [*owner, *series]
    span = cadence_span(df, owner, time, step_ns)
    names = df.select(*keys).distinct()
    good = df.filter(usable).select(*keys, time).distinct()
    inner = ordered.stencil(good, keys, [time], lambda w: {"__from": F.lag(time).over(w) + step_ns}, ahead=0, chunk=chunk)
    inner = inner.filter(F.col("__from") < F.col(time)).select(*keys, F.col("__from").alias("start_ns"), F.col(time).alias("end_ns"))
    edges = names.join(good.groupBy(*keys).agg(F.min(time).alias("__lo"), F.max(time).alias("__hi")), keys, "left").join(span, list(owner))
    stop = F.col("last_ns") + step_ns
    outer = edges.select(
        *keys,
        F.explode(
            F.when(F.col("__lo").isNull(), F.array(F.struct(F.col("first_ns").alias("start_ns"), stop.alias("end_ns")))).otherwise(
                F.array(
                    F.struct(F.col("first_ns").alias("start_ns"), F.col("__lo").alias("end_ns")),
                    F.struct((F.col("__hi") + step_ns).alias("start_ns"), stop.alias("end_ns")),
                )
            )
        ).alias("__i"),
    ).select(*keys, "__i.start_ns", "__i.end_ns").filter("start_ns < end_ns")
    both = inner.unionByName(outer)
    frames = F.call_function("div", F.col("end_ns") - F.col("start_ns"), F.lit(step_ns).cast("bigint"))
    return both.withColumns({"missing_frames": frames, "duration_s": (F.col("end_ns") - F.col("start_ns")) / 1e9})


def duplicate_frames(df: DataFrame, keys: Sequence[str], source_order: Sequence[str], frame: str, *, chunk: int | None) -> DataFrame:
    """Adds ``is_duplicate``: the frame number does not advance past the previous line's."""
    return ordered.stencil(
        df, keys, source_order, lambda w: {"is_duplicate": F.coalesce(F.col(frame) <= F.lag(frame).over(w), F.lit(False))}, ahead=0, chunk=chunk
    )


def first_per_object(df: DataFrame, keys: Sequence[str], source_order: Sequence[str]) -> DataFrame:
    """Keep the first row per key in source order; a partial aggregate, so a hot key stays cheap."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*source_order)).alias("__first")).select(*keys, "__first.*")


def frame_time_check(df: DataFrame, keys: Sequence[str], frame: str, time: str, step_ns: int, tolerance_ns: int) -> DataFrame:
    """Adds ``time_mismatch``: the clock disagrees with the frame counter from the first frame on."""
    origin = df.groupBy(*keys).agg(F.min_by(F.struct(F.col(frame).alias("f"), F.col(time).alias("t")), frame).alias("__origin"))
    expected = F.col("__origin.t") + (F.col(frame) - F.col("__origin.f")) * step_ns
    return ordered.attach(df, origin, keys, frame).withColumn("time_mismatch", F.abs(expected - F.col(time)) > tolerance_ns).drop("__origin")


def order_checks(df: DataFrame, keys: Sequence[str], source_order: Sequence[str], columns: Sequence[str], *, chunk: int | None) -> DataFrame:
    """Per key: rows where a column fails to increase, and where it repeats, against the previous source row."""

    def stage(w):
        out = {}
        for c in columns:
            out[f"__back_{c}"] = F.coalesce(F.col(c) < F.lag(c).over(w), F.lit(False))
            out[f"__same_{c}"] = F.coalesce(F.col(c) == F.lag(c).over(w), F.lit(False))
        return out

    marked = ordered.stencil(df, keys, source_order, stage, ahead=0, chunk=chunk)
    return marked.groupBy(*keys).agg(
        *[F.count_if(f"__back_{c}").alias(f"{c}_reordered") for c in columns],
        *[F.count_if(f"__same_{c}").alias(f"{c}_repeated") for c in columns],
        F.count(F.lit(1)).alias("rows"),
    )


def step_histogram(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, *, chunk: int | None) -> DataFrame:
    """How often each difference between consecutive values occurs."""
    stepped = ordered.stencil(df, keys, order, lambda w: {"delta": F.col(value) - F.lag(value).over(w)}, ahead=0, chunk=chunk)
    return stepped.filter(F.col("delta").isNotNull()).groupBy(*keys, "delta").agg(F.count(F.lit(1)).alias("steps"))


def trail(df: DataFrame, keys: Sequence[str], time: str, fields: Sequence[str], span_ns: int, *, chunk: int | None = DEFAULT_CHUNK_NS) -> DataFrame:
    """Recent positions of each entity, oldest first, at every sample."""
    item = F.struct(*fields)
    return ordered.trailing(df, keys, time, lambda ranged, along: {"trail": F.collect_list(item).over(ranged)}, span=span_ns, chunk=chunk)


def _hops(times, start: int, interval_ns: int) -> list[int]:
    """Positions taken from ``start`` on, each at least an interval after the one before."""
    taken, at = [], start
    while at < len(times):
        taken.append(at)
        at = int(np.searchsorted(times, times[at] + interval_ns))
    return taken


def _walk(pieces, begin: int | None, interval_ns: int) -> tuple[list[tuple[int, int]], int | None]:
    """Follow (id, entries) pieces in time order; entries map a first frame to the last one taken."""
    begins, last, due = [], None, begin
    for piece, entries in pieces:
        for entry in entries:
            if due is None or entry["start"] >= due:
                begins.append((piece, entry["start"]))
                last = entry["last"]
                due = last + interval_ns
                break
    return begins, last


def sample_frames(df: DataFrame, keys: Sequence[str], time: str, interval_ns: int, *, chunk: int, fan_in: int = 1000) -> DataFrame:
    """Frames at which a sampled output is due: the first, then each at least an interval after the last one taken.

    Which frame a chunk starts with depends on the chunk before it, but only frames
    in the first interval of a chunk, or the next one after it, can be its first.
    So each chunk answers, for every such start, which frame it would take last.  Blocks of ``fan_in`` chunks
    combine their answers the same way, one short walk per series links the blocks,
    and the starts are handed back down.  No task sees more than a chunk of frames
    or a block of answers.
    """
    keys = list(keys)
    width = max(chunk, interval_ns)
    key_fields = [df.schema[k] for k in keys]
    entry = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("last", T.LongType())]))

    def schema(*extra: T.StructField) -> T.StructType:
        return T.StructType([*key_fields, *extra])

    long = lambda name: T.StructField(name, T.LongType())
    frames = settle(ordered.with_chunk(df.select(*keys, time).distinct(), time, width))
    block = F.call_function("div", F.col(ordered.CHUNK), F.lit(fan_in).cast("bigint"))

    def repeat(key, count):
        return {k: [v] * count for k, v in zip(keys, key)}

    def chunk_answers(key, table):
        (times,) = sorted_columns(table, time)
        beyond = int(np.searchsorted(times, times[0] + interval_ns))
        starts = range(min(beyond + 1, len(times)))
        entries = [{"start": int(times[i]), "last": int(times[_hops(times, i, interval_ns)[-1]])} for i in starts]
        return repeat(key, 1) | {ordered.CHUNK: [key[-1]], "entries": [entries]}

    def pieces_of(table, column):
        return sorted(zip(table.column(column).to_pylist(), table.column("entries").to_pylist()), key=lambda p: p[0])

    def block_answers(key, table):
        pieces = pieces_of(table, ordered.CHUNK)
        origin = pieces[0][1][0]["start"]
        listed = sorted({e["start"] for _, entries in pieces for e in entries})
        beyond = next((i for i, s in enumerate(listed) if s - origin >= interval_ns), len(listed))
        entries = [{"start": s, "last": _walk(pieces, s, interval_ns)[1]} for s in listed[: beyond + 1]]
        return repeat(key, 1) | {"block": [key[-1]], "entries": [entries]}

    def series_walk(key, table):
        begins, _ = _walk(pieces_of(table, "block"), None, interval_ns)
        return repeat(key, len(begins)) | {"block": [b for b, _ in begins], "begin_ns": [s for _, s in begins]}

    def block_walk(key, table):
        begins, _ = _walk(pieces_of(table, ordered.CHUNK), table.column("begin_ns")[0].as_py(), interval_ns)
        return repeat(key, len(begins)) | {ordered.CHUNK: [c for c, _ in begins], "begin_ns": [s for _, s in begins]}

    def take(key, table):
        (times,) = sorted_columns(table, time)
        start = int(np.searchsorted(times, table.column("begin_ns")[0].as_py()))
        picked = times[_hops(times, start, interval_ns)]
        return repeat(key, len(picked)) | {time: picked}

    per_chunk = apply_grouped(frames, [*keys, ordered.CHUNK], chunk_answers, schema(long(ordered.CHUNK), T.StructField("entries", entry)))
    per_chunk = settle(per_chunk.withColumn("block", block))
    per_block = apply_grouped(per_chunk, [*keys, "block"], block_answers, schema(long("block"), T.StructField("entries", entry)))
    block_begins = apply_grouped(per_block, keys, series_walk, schema(long("block"), long("begin_ns")))
    chunk_begins = apply_grouped(per_chunk.join(block_begins, [*keys, "block"]), [*keys, "block"], block_walk, schema(long(ordered.CHUNK), long("begin_ns")))
    return apply_grouped(frames.join(chunk_begins, [*keys, ordered.CHUNK]), [*keys, ordered.CHUNK], take, schema(long(time)))
