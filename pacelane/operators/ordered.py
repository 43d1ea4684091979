"""Ordered work on long series, without ever sorting a whole series in one task.

A window partitioned by entity puts the entity in one task.  One session can hold
a large share of all rows, so every helper here cuts a series into chunks of its
integer order column (time in ns, or a sequence number) and works per
(keys, chunk).  What a chunk needs from its neighbours is small and is computed
from one row (or ``reach`` rows) per chunk:

* ``stencil``  - lag/lead style columns; edge rows are copied to the next chunk
* ``running``  - prefix sums and carried values; one summary row per chunk
* ``trailing`` - range windows of a fixed span; rows near the end of a chunk are
  copied into the next one
* ``number``   - dense numbering

Order columns should be non-null and, together, unique per key; rows without an order value come first.  Null keys
are one key like any other, with every chunk setting.  ``chunk=None``
means the caller knows the groups are small (plays of one game, say) and a plain
window is used.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

CHUNK = "__chunk"
HALO = "__halo"
SALTS = 16
NOWHERE = -(1 << 62)

Stage = Callable[[WindowSpec], Mapping[str, Column]]


def chunk_number(order: str | Column, chunk: int) -> Column:
    """Exact floor division of a BIGINT column (no detour through DOUBLE)."""
    value = F.col(order) if isinstance(order, str) else order
    value = value.cast("bigint")
    width = F.lit(int(chunk)).cast("bigint")
    return F.call_function("div", value - F.pmod(value, width), width)


def with_chunk(df: DataFrame, order: str, chunk: int) -> DataFrame:
    """Chunk of every row; rows without an order value form one chunk before all others, as nulls sort first."""
    return df.withColumn(CHUNK, F.coalesce(chunk_number(order, chunk), F.lit(NOWHERE)))


def _whole_keys(df: DataFrame, keys: Sequence[str]) -> dict[str, Column]:
    """Stand-ins of the keys without nulls, so that a join on them loses no row: the values, and which of them are missing."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    out = {f"__key{n}": F.coalesce(F.col(k), F.lit("" if kinds[k] in ("string", "binary") else 0).cast(kinds[k])) for n, k in enumerate(keys)}
    return out | {"__missing": F.concat(*[F.col(k).isNull().cast("int").cast("string") for k in keys]) if keys else F.lit("")}


def _add(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    return df.withColumns(dict(columns)) if columns else df


def attach(df: DataFrame, per_key: DataFrame, keys: Sequence[str], by: str | Column, how: str = "inner") -> DataFrame:
    """Join one row per key to all rows of the key without gathering a hot key in one task.

    The rows of a key are dealt over ``SALTS`` shares by the hash of ``by``; the
    small side is repeated once per share.  A plain join would also leave the rows
    partitioned by key alone, which already satisfies a later window by key and
    chunk, so that window would run in one task per key.
    """
    share = F.pmod(F.xxhash64(by), F.lit(SALTS).cast("bigint"))
    shares = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint")))
    small = per_key.withColumns({f"__of_{k}": F.col(k) for k in keys}).drop(*keys).withColumn("__of_share", shares)
    same = F.col("__share") == F.col("__of_share")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__of_{k}"))
    return df.withColumn("__share", share).join(small, same, how).drop("__share", "__of_share", *[f"__of_{k}" for k in keys])


def stencil(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *stages: Stage,
    back: int = 1,
    ahead: int = 1,
    chunk: int | None,
) -> DataFrame:
    """Apply window stages that look at most ``back`` / ``ahead`` rows away.

    Stages run one after another over the same window, so a second stage may use
    the columns of the first; ``back`` and ``ahead`` are the total reach.
    """
    keys, order = list(keys), list(order)
    if chunk is None:
        window = Window.partitionBy(*keys).orderBy(*order)
        for stage in stages:
            df = _add(df, stage(window))
        return df

    columns = df.columns
    cut = with_chunk(df, order[0], chunk)
    local = Window.partitionBy(*keys, CHUNK)
    along = Window.partitionBy(*keys).orderBy(*order)
    pieces = [cut.withColumn(HALO, F.lit(False))]
    whole_row = F.struct(*columns)
    if back:
        tail = (
            cut.withColumn("__rank", F.row_number().over(local.orderBy(*[F.desc(c) for c in order])))
            .filter(F.col("__rank") <= back)
            .withColumn("__copies", F.collect_list(whole_row).over(along.rowsBetween(-(back - 1), 0)))
            .withColumn("__to", F.lead(CHUNK).over(along))
            .filter(F.col("__to") > F.col(CHUNK))
        )
        pieces.append(tail.select(F.col("__to").alias(CHUNK), F.explode("__copies").alias("__row")).select("__row.*", CHUNK, F.lit(True).alias(HALO)))
    if ahead:
        head = (
            cut.withColumn("__rank", F.row_number().over(local.orderBy(*order)))
            .filter(F.col("__rank") <= ahead)
            .withColumn("__copies", F.collect_list(whole_row).over(along.rowsBetween(0, ahead - 1)))
            .withColumn("__to", F.lag(CHUNK).over(along))
            .filter(F.col("__to") < F.col(CHUNK))
        )
        pieces.append(head.select(F.col("__to").alias(CHUNK), F.explode("__copies").alias("__row")).select("__row.*", CHUNK, F.lit(True).alias(HALO)))
    out = pieces[0]
    for piece in pieces[1:]:
        out = out.unionByName(piece)
    window = local.orderBy(*order)
    for stage in stages:
        out = _add(out, stage(window))
    return out.filter(~F.col(HALO)).drop(HALO, CHUNK)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    chunk: int | None,
    sums: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    nexts: Mapping[str, Column] | None = None,
    maxima: Mapping[str, Column] | None = None,
    maxima_before: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Inclusive prefix sums / maxima, maxima of the earlier rows only, last non-null value so far, next non-null value.

    Each chunk is reduced to one row first; only those rows are ordered per key.
    """
    sums, lasts, nexts, maxima = dict(sums or {}), dict(lasts or {}), dict(nexts or {}), dict(maxima or {})
    passed = dict(maxima_before or {})
    keys, order = list(keys), list(order)
    if chunk is None:
        whole = Window.partitionBy(*keys).orderBy(*order)
        before, after = whole.rowsBetween(Window.unboundedPreceding, 0), whole.rowsBetween(0, Window.unboundedFollowing)
        return _add(
            df,
            {n: F.sum(e).over(before) for n, e in sums.items()}
            | {n: F.max(e).over(before) for n, e in maxima.items()}
            | {n: F.max(e).over(whole.rowsBetween(Window.unboundedPreceding, -1)) for n, e in passed.items()}
            | {n: F.last(e, ignorenulls=True).over(before) for n, e in lasts.items()}
            | {n: F.first(e, ignorenulls=True).over(after) for n, e in nexts.items()},
        )

    stand_ins = _whole_keys(df, keys)
    cut = with_chunk(df, order[0], chunk).withColumns(stand_ins)
    keys = list(stand_ins)
    position = F.struct(*order)
    summary = cut.groupBy(*keys, CHUNK).agg(
        *[F.sum(e).alias(f"__sum_{n}") for n, e in sums.items()],
        *[F.max(e).alias(f"__max_{n}") for n, e in (maxima | passed).items()],
        *[F.max_by(e, F.when(e.isNotNull(), position)).alias(f"__last_{n}") for n, e in lasts.items()],
        *[F.min_by(e, F.when(e.isNotNull(), position)).alias(f"__next_{n}") for n, e in nexts.items()],
    )
    over_chunks = Window.partitionBy(*keys).orderBy(CHUNK)
    earlier, later = over_chunks.rowsBetween(Window.unboundedPreceding, -1), over_chunks.rowsBetween(1, Window.unboundedFollowing)
    carry = summary.select(
        *keys,
        CHUNK,
        *[F.sum(f"__sum_{n}").over(earlier).alias(f"__sum_{n}") for n in sums],
        *[F.max(f"__max_{n}").over(earlier).alias(f"__max_{n}") for n in maxima | passed],
        *[F.last(f"__last_{n}", ignorenulls=True).over(earlier).alias(f"__last_{n}") for n in lasts],
        *[F.first(f"__next_{n}", ignorenulls=True).over(later).alias(f"__next_{n}") for n in nexts],
    )
    local = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    before, after = local.rowsBetween(Window.unboundedPreceding, 0), local.rowsBetween(0, Window.unboundedFollowing)
    # The windows come before the join: their order serves a merge join too, so a task sorts and holds its rows once.
    here = (
        {n: F.sum(e).over(before) for n, e in sums.items()}
        | {n: F.max(e).over(before) for n, e in maxima.items()}
        | {n: F.max(e).over(local.rowsBetween(Window.unboundedPreceding, -1)) for n, e in passed.items()}
        | {n: F.last(e, ignorenulls=True).over(before) for n, e in lasts.items()}
        | {n: F.first(e, ignorenulls=True).over(after) for n, e in nexts.items()}
    )
    out = _add(cut, {f"__here_{n}": e for n, e in here.items()}).join(carry, [*keys, CHUNK])
    new: dict[str, Column] = {}
    for n in sums:
        own = F.col(f"__here_{n}")
        new[n] = F.when(own.isNull(), F.col(f"__sum_{n}")).otherwise(F.coalesce(F.col(f"__sum_{n}"), F.lit(0)) + own)
    for n in maxima | passed:
        new[n] = F.greatest(F.col(f"__max_{n}"), F.col(f"__here_{n}"))
    for n in lasts:
        new[n] = F.coalesce(F.col(f"__here_{n}"), F.col(f"__last_{n}"))
    for n in nexts:
        new[n] = F.coalesce(F.col(f"__here_{n}"), F.col(f"__next_{n}"))
    helper = [CHUNK, *keys, *[f"__here_{n}" for n in here], *[c for c in carry.columns if c.startswith("__")]]
    return _add(out, new).drop(*helper)


def trailing(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    *stages: Callable[[WindowSpec, WindowSpec], Mapping[str, Column]],
    span: int,
    chunk: int | None,
    tie: Sequence[str] = (),
) -> DataFrame:
    """Stages over the closed range [t - span, t]; each gets (range window, ordered window)."""
    keys = list(keys)
    if chunk is None:
        base = Window.partitionBy(*keys)
        ranged, ordered = base.orderBy(time).rangeBetween(-span, 0), base.orderBy(time, *tie)
        for stage in stages:
            df = _add(df, stage(ranged, ordered))
        return df
    width = max(int(chunk), int(span))
    cut = with_chunk(df, time, width)
    reaches_next = F.col(time) >= (F.col(CHUNK) + 1) * F.lit(width).cast("bigint") - F.lit(int(span)).cast("bigint")
    copies = F.when(reaches_next, F.array(F.col(CHUNK), F.col(CHUNK) + 1)).otherwise(F.array(F.col(CHUNK)))
    out = cut.withColumn("__home", F.col(CHUNK)).withColumn(CHUNK, F.explode(copies))
    out = out.withColumn(HALO, F.col(CHUNK) != F.col("__home")).drop("__home")
    base = Window.partitionBy(*keys, CHUNK)
    ranged, ordered = base.orderBy(time).rangeBetween(-span, 0), base.orderBy(time, *tie)
    for stage in stages:
        out = _add(out, stage(ranged, ordered))
    return out.filter(~F.col(HALO)).drop(HALO, CHUNK)


def number(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, *, chunk: int | None, start: int = 0) -> DataFrame:
    """Dense numbering of each key's rows in order."""
    numbered = running(df, keys, order, chunk=chunk, sums={out: F.lit(1).cast("bigint")})
    return numbered.withColumn(out, F.col(out) + F.lit(start - 1).cast("bigint"))


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], starts: Column, out: str, *, chunk: int | None) -> DataFrame:
    """Zero-based index of the island a row belongs to; ``starts`` is true on a first row."""
    flagged = running(df, keys, order, chunk=chunk, sums={out: F.when(starts, 1).otherwise(0).cast("bigint")})
    return flagged.withColumn(out, F.col(out) - 1)
