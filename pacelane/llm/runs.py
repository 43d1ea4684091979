"""Periodic runs of words.

A run is a longest stretch of words with smallest period ``q`` that has at least ``max(SHORTEST, 3 * q)`` words.  Words ``i`` and
``i + q`` match along ``length - q`` places, so a run is a longest stretch of matches at distance ``q``.

Periods are taken by octave, from 1 to 15 and then from ``w`` to ``2 * w - 1`` for ``w`` = 16, 32, ....  In every octave a
document is cut into overlapping tiles, which are solved apart from each other.  A tile has boundaries ``w`` words apart (8
in the first octave); every run's matches cover the ``w`` words after some boundary.  The Z function of a boundary, how
far the words after it match those ``q`` further on, is asked for the periods of the octave at once: it is at least ``w``
where the numbers of two windows of ``w`` words are equal; there its value, and that of the words before the boundary, is found by
halving over prefix sums.  Periods that are a multiple of a smaller one are dropped, since a window shows it.

Tiles report match stretches, cut off at their ends.  These fragments are shuffled by document and period and stitched:
a tile reaches ``w`` words before and ``3 * w`` words behind its boundaries, so the fragments of one stretch overlap.

Words have 64-bit numbers; equal numbers count as equal words.  Null, empty and short texts have no runs.  Rows with equal
id and text have the same runs, given once.  A null id is an id.  Tiles of texts above ``LONG`` bytes are dealt over the cluster; the
others are solved where their text is read.  The result does not depend on it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pacelane.llm.frames import settle, ship_package
from pacelane.llm.words import U64, find_words, power_tables, slices

SHORTEST = 24
FIRST = 8
"""Window of the first octave."""
SPAN = 12
"""Words of a tile between its first and its last boundary, in windows of its largest octave."""
SMALL = 256
"""Octaves up to this window share their tiles."""
LONG = 4 << 20
CELLS = 1 << 21
"""Windows compared at once."""


class Tile(NamedTuple):
    """A part of a document: its word count, where the tile starts, from where to where its boundaries lie, its least and greatest window, its words."""

    words: int
    start: int
    first: int
    last: int
    low: int
    high: int
    code: np.ndarray


def tiles(code: np.ndarray, small: int = SMALL) -> Iterator[Tile]:
    """Tiles of all octaves of one document; octaves whose tile is the whole document share it."""
    n, low, high = len(code), FIRST, small
    while 3 * low <= n:
        step = SPAN * high
        if step >= n:
            yield Tile(n, 0, 0, n, low, n // 3, code)
            return
        for first in range(0, n, step):
            start, stop = max(0, first - high), min(n, first + step + 3 * high)
            yield Tile(n, start, first, min(n, first + step), low, high, code[start:stop])
        low = high = 2 * high


_least_factor = np.arange(4)


def _factors(top: int) -> np.ndarray:
    """Smallest prime factor of every number up to ``top``."""
    global _least_factor
    if len(_least_factor) <= top:
        size = 1 << int(top).bit_length()
        table = np.arange(size)
        for p in range(2, int(size**0.5) + 1):
            if table[p] == p:
                multiples = table[p * p :: p]
                multiples[multiples == np.arange(p * p, size, p)] = p
        _least_factor = table
    return _least_factor


def solve(parts: list[Tile]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Match stretches in tiles: tile, period, first place, place behind the last (places of the document)."""
    size = np.array([len(p.code) for p in parts])
    end = np.cumsum(size)
    begin = end - size
    code = np.concatenate([p.code for p in parts])
    start, first, last, low, high, words = (np.array([p[k] for p in parts]) for k in (1, 2, 3, 4, 5, 0))
    up, down = power_tables(len(code) + 1)
    sums = np.zeros(len(code) + 1, U64)
    np.cumsum(code * up[: len(code)], out=sums[1:])

    def number(at: np.ndarray, length: np.ndarray) -> np.ndarray:
        return (sums[at + length] - sums[at]) * down[at]

    def reach(top: np.ndarray, least: np.ndarray, same) -> np.ndarray:
        """The greatest length up to ``top`` that is the ``same``."""
        low, high = least.copy(), top.copy()
        while (open_ := low < high).any():
            middle = (low + high + 1) // 2
            good = same(middle)
            low, high = np.where(open_ & good, middle, low), np.where(open_ & ~good, middle - 1, high)
        return low

    found = []
    window = FIRST
    while window <= high.max():
        chosen = np.flatnonzero((low <= window) & (window <= high))
        at_window, window = window, 2 * window
        if not len(chosen):
            continue
        w = at_window
        least = 1 if w == FIRST else w
        period = np.arange(least, 2 * w)
        limit = end[chosen].max()
        windows = (sums[w : limit + 1] - sums[: limit + 1 - w]) * down[: limit + 1 - w]
        count = -(-(last[chosen] - first[chosen]) // w)
        tile = np.repeat(chosen, count)
        turn = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        x = begin[tile] + first[tile] - start[tile] + turn * w
        fits = x + least + w <= end[tile]
        tile, x = tile[fits], x[fits]
        rows = max(1, CELLS // len(period))
        for k in range(0, len(x), rows):
            xs, ts = x[k : k + rows], tile[k : k + rows]
            other = xs[:, None] + period
            equal = windows[np.minimum(other, len(windows) - 1)] == windows[xs][:, None]
            i, j = np.nonzero(equal & (other + w <= end[ts][:, None]))
            if not len(i):
                continue
            at, t, q = xs[i], ts[i], period[j]
            whole = np.ones(len(q), bool)
            rest, table = q.copy(), _factors(2 * w)
            while (more := rest > 1).any():
                shift = np.where(more, q // np.maximum(table[rest], 1), q)
                whole &= ~more | (number(at, w + q - shift) != number(at + shift, w + q - shift))
                rest = np.where(more, rest // np.maximum(table[rest], 1), rest)
            at, t, q = at[whole], t[whole], q[whole]
            ahead = reach(end[t] - at - q, np.full(len(q), w), lambda m: number(at, m) == number(at + q, m))  # noqa: B023
            back = reach(at - begin[t], np.zeros(len(q), np.int64), lambda m: number(at - m, m) == number(at + q - m, m))  # noqa: B023
            # a stretch that ends inside the tile and is too short is no run
            closed = ((at - back > begin[t]) | (start[t] == 0)) & ((at + ahead + q < end[t]) | (start[t] + size[t] == words[t]))
            keep = ~closed | (back + ahead + q >= np.maximum(SHORTEST, 3 * q))
            move = start[t] - begin[t]
            found.append(np.stack([t, q, at - back + move, at + ahead + move], axis=1)[keep])
    rows = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 4), np.int64)
    return rows[:, 0], rows[:, 1], rows[:, 2], rows[:, 3]


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def fragments(df: DataFrame, id_column: str, text_column: str, long: int = LONG, small: int = SMALL) -> DataFrame:
    """``id``, ``text_hash``, ``period``, ``low``, ``high``: match stretches of the tiles."""
    ship_package(df.sparkSession)
    text = F.col(f"`{text_column}`")
    rows = df.select(F.col(f"`{id_column}`").alias("id"), text_hash(text).alias("text_hash"), text.alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    wanted = f"id {kind}, text_hash long, period long, low long, high long"
    names = ["id", "text_hash", "period", "low", "high"]
    plan = ["words", "start", "first", "last", "least", "most", "code"]

    def cut(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list[Tile]]]:
        for at, _, data, offsets in slices(batch.column(2)):
            found = find_words(data, offsets, fold=False)
            owners, parts = [], []
            for k in range(len(offsets) - 1):
                for tile in tiles(found.code[found.first[k] : found.first[k + 1]], small):
                    owners.append(at + k)
                    parts.append(tile)
            if parts:
                yield np.array(owners), parts

    def answer(batch: pa.RecordBatch, owners: np.ndarray, parts: list[Tile]) -> pa.RecordBatch:
        tile, *stretch = solve(parts)
        of = pa.array(owners[tile])
        return pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), *map(pa.array, stretch)], names)

    def here(batches):
        for batch in batches:
            for owners, parts in cut(batch):
                yield answer(batch, owners, parts)

    def explode(batches):
        for batch in batches:
            for owners, parts in cut(batch):
                for owner, tile in zip(owners, parts, strict=True):
                    of = pa.array([owner])
                    numbers = [pa.array([v], pa.int64()) for v in tile[:-1]]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), *numbers, pa.array([tile.code.tobytes()], pa.binary())], ["id", "text_hash", *plan])

    def there(batches):
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(2, 9)]
            for k, (*numbers, code) in enumerate(zip(*columns, strict=True)):
                yield answer(batch, np.array([k]), [Tile(*numbers, np.frombuffer(code, U64))])

    bulky = F.coalesce(F.octet_length("text"), F.lit(0)) > long
    apart = rows.where(bulky).mapInArrow(explode, f"id {kind}, text_hash long, {', '.join(f'{c} long' for c in plan[:-1])}, code binary")
    return rows.where(~bulky).mapInArrow(here, wanted).unionByName(apart.repartition("id", "text_hash", "least", "first").mapInArrow(there, wanted))


def periodic_runs(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", long: int = LONG, small: int = SMALL) -> DataFrame:
    """``id``, ``text_hash``, ``start``, ``length``, ``period`` of every run of the texts, in words from 0."""
    found = fragments(df, id_column, text_column, long, small).distinct()
    stretch = ["id", "text_hash", "period"]
    along = Window.partitionBy(*stretch).orderBy("low", "high")
    before = F.max("high").over(along.rowsBetween(Window.unboundedPreceding, -1))
    marked = found.withColumn("new", F.coalesce(before < F.col("low"), F.lit(True)).cast("int"))
    marked = marked.withColumn("part", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    joined = marked.groupBy(*stretch, "part").agg(F.min("low").alias("start"), F.max("high").alias("high"))
    runs = joined.select("id", "text_hash", "start", (F.col("high") - F.col("start") + F.col("period")).alias("length"), "period")
    return runs.where(F.col("length") >= F.greatest(F.lit(SHORTEST), 3 * F.col("period")))


def with_runs(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """``df`` with ``runs``: start, length and period of each run by start, then period; null if there is none."""
    runs = settle(periodic_runs(df, id_column, text_column, **options))
    held = runs.groupBy(F.col("id").alias("__id"), F.col("text_hash").alias("__hash")).agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("__found"))
    held = held.select("__id", "__hash", F.transform("__found", lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period"))).alias("runs"))
    keyed = df.drop("runs").withColumn("__own", text_hash(F.col(f"`{text_column}`")))
    # the plan stays the same at every size: runs grow with the documents
    joined = keyed.join(held.hint("merge"), F.col(f"`{id_column}`").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__hash")), "left")
    return joined.drop("__id", "__hash", "__own")


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    inside = np.cumsum(change)[:-1] > 0
    return [words[k] for k in np.flatnonzero(~inside)]


def collapse(df: DataFrame, text_column: str = "text") -> DataFrame:
    """``df`` (with ``runs``) whose text keeps one period of every run; words are joined by one space, also without runs."""

    def keep(batches):
        for batch in batches:
            place = batch.schema.get_field_index(text_column)
            texts, runs = batch.column(place).to_pylist(), batch.column(batch.schema.get_field_index("runs")).to_pylist()
            out = [b" ".join(collapsed(t.encode().split(), _spans(r))).decode() if t is not None else None for t, r in zip(texts, runs, strict=True)]
            yield batch.set_column(place, batch.schema.field(place), pa.array(out, batch.schema.field(place).type))

    return df.mapInArrow(keep, df.schema)


def _spans(runs: list[dict] | None) -> list[tuple[int, int, int]]:
    return [(r["start"], r["length"], r["period"]) for r in runs or []]


def digest(df: DataFrame) -> DataFrame:
    """Per document (``doc_id``, ``text``, ``runs``): count of runs, the one with most periods, hashes of all runs and of the collapsed text."""
    ship_package(df.sparkSession)

    def hashes(batches):
        for batch in batches:
            listed, kept = [], []
            for text, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                spans = _spans(runs)
                listed.append(hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in spans).encode()).hexdigest())
                words = (text or "").encode().split()
                kept.append(hashlib.sha256(b" ".join(collapsed(words, spans) if spans else words)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(listed), pa.array(kept)], ["doc_id", "runs", "runs_sha256", "collapsed_sha256"])

    rows = df.select("doc_id", "text", "runs")
    kinds = [f"{n} {rows.schema[n].dataType.simpleString()}" for n in ("doc_id", "runs")]
    found = rows.mapInArrow(hashes, f"{', '.join(kinds)}, runs_sha256 string, collapsed_sha256 string")
    ranked = F.transform("runs", lambda r: F.struct((-r["length"] / r["period"]).alias("few"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))
    best = F.array_min(ranked)
    found = found.withColumn("best", best)
    return found.select(
        "doc_id",
        F.coalesce(F.size("runs"), F.lit(0)).cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )
