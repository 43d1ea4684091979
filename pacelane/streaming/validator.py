"""Incremental validation of live streams with keyed state.

The samples of a stream are cut into chunks of their index, and neighbouring chunks are gathered in lots of at most ``WIDTH``
indices (or one chunk).  Every lot has a state of its own (``transformWithState``): rows seen, failed rows of every check, least and
greatest value of columns that must hold one value, and for each chunk its first and last sample and order violations.  So a
stream that sends most of the rows works in many tasks, the state of a lot is one small row, and narrow chunks do not cost a
state each.

After each micro-batch the lots it touched report their state; ``finish`` reads the last report of each, compares the edges
of neighbouring lots and returns the rows that ``quality.validate`` gives for the same samples at once.  How the
samples were split into micro-batches, and restarts from the checkpoint, change nothing.  A sample that arrives after a
later one of its chunk counts as an order violation, as it would for a reader of the stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pacelane.operators import ordered, quality
from pacelane.schema import StreamContract
from pacelane.session import ship_package

WIDTH = 100_000
"""Sample indices of a chunk."""
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PIECE = """rows bigint, failed array<bigint>, low array<string>, high array<string>, first_index bigint, first_t bigint, last_index bigint, last_t bigint,
    indexed bigint, late_index bigint, late_t bigint"""


FIELDS = [c.split()[0] for c in PIECE.replace("\n", " ").split(", ")]
EDGES = ("first_index", "first_t", "last_index", "last_t", "indexed", "late_index", "late_t")
STATE = f"rows bigint, failed array<bigint>, low array<string>, high array<string>, chunks array<bigint>, {', '.join(f'{c} array<bigint>' for c in EDGES)}"
PART = "seen bigint, failed array<bigint>, low array<string>, high array<string>, indices binary, times binary, timed binary"


def _edge(pick, values: tuple):
    """Least or greatest of the values there are."""
    return pick([v for v in values if v is not None], default=None)


def _pack(batches: Iterator[pa.RecordBatch], checks: int) -> Iterator[pa.RecordBatch]:
    """Samples of a task as one row for each stream and lot: counts, extremes, and the indices and times as arrays."""
    for batch in batches:
        if not batch.num_rows:
            continue
        chunk, mask, index, known, t, timed = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(1, 7))
        code = batch.column(0).dictionary_encode("encode").indices.to_numpy()
        order = np.lexsort((chunk, code))
        cuts = np.flatnonzero((np.diff(code[order]) != 0) | (np.diff(chunk[order]) != 0)) + 1
        groups = np.split(order, cuts)
        out: list[list] = [[] for _ in range(7)]
        for rows in groups:
            extremes = [pc.min_max(batch.column(k).take(pa.array(rows))).as_py() for k in range(7, batch.num_columns)]
            some = rows[known[rows]]
            row = (
                len(rows), [int((mask[rows] >> k & 1).sum()) for k in range(checks)], [e["min"] for e in extremes], [e["max"] for e in extremes],
                index[some].tobytes(), t[some].tobytes(), timed[some].tobytes(),
            )
            for column, value in zip(out, row, strict=True):
                column.append(value)
        heads = pa.array([g[0] for g in groups])
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.binary()]
        columns = [batch.column(0).take(heads), batch.column(1).take(heads), *[pa.array(c, k) for c, k in zip(out, kinds, strict=True)]]
        yield pa.RecordBatch.from_arrays(columns, ["stream_id", "chunk", *[c.split()[0] for c in PART.split(", ")]])


def _names(contract: StreamContract, columns: list[str]) -> tuple[dict, dict]:
    """Row checks and single-valued columns, but those of the stream id, which is the key."""
    checks = quality.row_checks(contract, columns)
    if contract.dense:
        checks |= {f"time.null:{c}": F.col(c).isNull() for c in ("sample_index", "t_rel_ns")}
    single = quality.single_values(contract, columns)
    return tuple({n: v for n, v in d.items() if not n.endswith(":stream_id")} for d in (checks, single))


def _tally(edges: dict[int, list], index: np.ndarray, t: np.ndarray, timed: np.ndarray, width: int, strict: bool) -> None:
    """Take samples into the edges and order violations of their chunks (``EDGES``), each chunk after what it had before."""
    order = np.lexsort((np.where(timed, t, 0), index))
    index, t, timed = index[order], t[order], timed[order]
    chunk = index // width
    starts = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]])
    ends = np.r_[starts[1:], len(chunk)]
    # The sample before each one: its neighbour, or at a chunk's start the last one of the chunk so far.
    had = [edges.get(c) for c in chunk[starts].tolist()]
    known, of_index, of_t, of_timed = np.ones(len(index), dtype=bool), np.r_[0, index[:-1]], np.r_[0, t[:-1]], np.r_[False, timed[:-1]]
    known[starts] = [e is not None for e in had]
    of_index[starts] = [0 if e is None else e[2] for e in had]
    of_t[starts] = [0 if e is None or e[3] is None else e[3] for e in had]
    of_timed[starts] = [e is not None and e[3] is not None for e in had]
    late_index = np.add.reduceat(known & (index <= of_index), starts, dtype=np.int64)
    late_t = np.add.reduceat(timed & of_timed & (t <= of_t if strict else t < of_t), starts, dtype=np.int64)
    sample = lambda k: [int(index[k]), int(t[k]) if timed[k] else None]
    for c, old, start, end, i, at in zip(chunk[starts].tolist(), had, starts.tolist(), ends.tolist(), late_index.tolist(), late_t.tolist(), strict=True):
        first = old[:2] if old and old[0] <= index[start] else sample(start)
        so_far = old[4:] if old else [0, 0, 0]
        edges[c] = [*first, *sample(end - 1), so_far[0] + end - start, so_far[1] + i, so_far[2] + at]


def _lot(edges: dict[int, list], strict: bool) -> tuple:
    """The edges of a lot as those of one long chunk: neighbouring chunks are compared here."""
    if not edges:
        return None, None, None, None, 0, 0, 0
    ranked = [edges[c] for c in sorted(edges)]
    indexed, late_index, late_t = (sum(e[k] for e in ranked) for k in (4, 5, 6))
    for a, b in zip(ranked, ranked[1:]):
        late_index += b[0] <= a[2]
        late_t += a[3] is not None and b[1] is not None and (b[1] <= a[3] if strict else b[1] < a[3])
    return *ranked[0][:2], *ranked[-1][2:4], indexed, late_index, late_t


class Tally(StatefulProcessor):
    """State of one lot of one stream; reports it whenever samples arrive."""

    def __init__(self, strict: bool, width: int):
        self.strict, self.width = strict, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.piece = handle.getValueState("piece", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = pd.concat(list(rows), ignore_index=True)
        old = self.piece.get() if self.piece.exists() else None
        failed = np.sum([*parts["failed"], *([old[1]] if old else [])], axis=0, dtype=np.int64).tolist()
        low, high = ([_edge(f, values) for values in zip(*parts[c], *([old[k]] if old else []), strict=True)] for f, c, k in ((min, "low", 2), (max, "high", 3)))
        index, t = (np.concatenate([np.frombuffer(p, np.int64) for p in parts[c]]) for c in ("indices", "times"))
        timed = np.concatenate([np.frombuffer(p, bool) for p in parts["timed"]])
        edges = {c: list(e) for c, *e in zip(*old[4:], strict=True)} if old else {}
        if len(index):
            _tally(edges, index, t, timed, self.width, self.strict)
        head = ((old[0] if old else 0) + int(parts["seen"].sum()), failed, low, high)
        self.piece.update((*head, list(edges), *([e[k] for e in edges.values()] for k in range(len(EDGES)))))
        row = (*key, *head, *_lot(edges, self.strict))
        yield pd.DataFrame([row], columns=["stream_id", "chunk", *FIELDS]).astype({c: "Int64" for c in FIELDS if c not in ("failed", "low", "high")})

    def close(self) -> None:
        pass


def pieces(stream: DataFrame, contract: StreamContract, *, width: int = WIDTH) -> DataFrame:
    """Reports of a stream's lots, as a stream: the state of each lot that a micro-batch touched.

    Checks are column expressions, one bit for each that a sample fails.  Samples are packed before they are shuffled to their lot's state.
    """
    spark = stream.sparkSession
    ship_package(spark)
    spark.conf.set(STORE, ROCKS)
    checks, single = _names(contract, stream.columns)
    failed = F.lit(0).cast("bigint")
    for k, check in enumerate(checks.values()):
        failed = failed + F.when(check, F.lit(1 << k).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    values = [F.col(c).cast("string") for c in single.values()]
    zero = F.lit(0).cast("bigint")
    if contract.dense:
        index, t = F.col("sample_index"), F.col("t_rel_ns")
        chunk = F.coalesce(ordered.chunk_number("sample_index", width * max(1, WIDTH // width)), F.lit(ordered.NOWHERE))
    else:
        index, t, chunk = [F.lit(None).cast("bigint")] * 2 + [F.pmod(F.xxhash64(*values), F.lit(ordered.SALTS).cast("bigint"))]
    columns = [chunk, failed, F.coalesce(index, zero), index.isNotNull(), F.coalesce(t, zero), t.isNotNull(), *values]
    rows = stream.select("stream_id", *[c.alias(f"c{k}") for k, c in enumerate(columns)])
    kind = f"stream_id {stream.schema['stream_id'].dataType.simpleString()}, chunk bigint"
    many = len(checks)
    packed = rows.mapInArrow(lambda batches: _pack(batches, many), f"{kind}, {PART}")
    return packed.groupBy("stream_id", "chunk").transformWithStateInPandas(Tally(contract.strict_time, width), f"{kind}, {PIECE}", "append", "none")


def finish(reports: DataFrame, contract: StreamContract, columns: list[str], *, width: int = WIDTH) -> DataFrame:
    """``stream_id``, ``rule``, ``violations`` of the samples reported so far."""
    checks, single = _names(contract, columns)
    last = reports.groupBy("stream_id", "chunk").agg(F.max_by(F.struct(*FIELDS), "rows").alias("p")).select("stream_id", "chunk", "p.*")
    sums = [F.sum(F.get("failed", F.lit(k))).alias(f"r{k}") for k in range(len(checks))]
    several = [F.when(F.min(F.get("low", F.lit(k))) != F.max(F.get("high", F.lit(k))), 1).otherwise(0).alias(f"s{k}") for k in range(len(single))]
    grouped = last.groupBy("stream_id").agg(*sums, *several)
    items = {**{n: f"r{k}" for k, n in enumerate(checks)}, **{n: f"s{k}" for k, n in enumerate(single)}}
    listed = lambda pairs: F.array(*[F.struct(F.lit(n).alias("rule"), F.col(c).cast("bigint").alias("violations")) for n, c in pairs.items()])
    out = grouped.select("stream_id", F.inline(listed(items)))
    if contract.dense:
        edges = last.filter("indexed > 0")

        def stage(w: Window) -> dict:
            """The first sample of a piece against the last one of the piece before it."""
            step = F.col("first_t") - F.lag("last_t").over(w)
            late = step <= 0 if contract.strict_time else step < 0
            return {"__t": F.coalesce(late, F.lit(False)), "__i": F.coalesce(F.col("first_index") <= F.lag("last_index").over(w), F.lit(False))}

        marked = ordered.stencil(edges, ["stream_id"], ["first_index", "chunk"], stage, ahead=0, chunk=width * 1000)
        order = marked.groupBy("stream_id").agg(
            (F.sum("late_index") + F.count_if("__i")).alias("i"),
            (F.sum("late_t") + F.count_if("__t")).alias("t"),
            F.when(F.min("first_index") != 0, 1).otherwise(0).alias("z"),
            F.when(F.max("last_index") != F.sum("indexed") - 1, 1).otherwise(0).alias("c"),
        )
        rules = {"time.monotonic:sample_index": "i", "time.monotonic:t_rel_ns": "t", "time.zero_based": "z", "time.contiguous": "c"}
        out = out.unionByName(order.select("stream_id", F.inline(listed(rules))))
    return out.filter("violations > 0")


def validate_live(stream: DataFrame, contract: StreamContract, path: str, *, width: int = WIDTH) -> DataFrame:
    """Take in what a stream has available and return the violations so far; ``path`` keeps checkpoint and reports between runs."""
    reports = pieces(stream, contract, width=width)
    schema = reports.schema
    sink = reports.writeStream.format("parquet").outputMode("append").option("path", f"{path}/reports").option("checkpointLocation", f"{path}/checkpoint")
    sink.trigger(availableNow=True).start().awaitTermination()
    return finish(stream.sparkSession.read.schema(schema).parquet(f"{path}/reports"), contract, stream.columns, width=width)
