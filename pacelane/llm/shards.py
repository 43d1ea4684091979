"""Sharding by a two-pass external shuffle.

First pass: every row goes to a bucket by a seeded hash of its id and text, as many buckets as keep each near
``bucket_bytes``.  Second pass: each bucket, small enough for one task's memory, is put in a fixed order and shuffled
by Fisher and Yates with a generator seeded by the bucket.  The buckets one after another form one random order of all
rows; its position ``p`` gives shard ``p mod n`` and slot ``p div n``, so shard counts differ by one at most and slots
have no gaps (law ``rows``).

Equal texts with different ids are dealt independently.  Rows that agree in id and text are interchangeable; they share a
bucket unless they overfill it.  Then they are numbered, group by group of ``GROUP`` rows, and each goes its own way
by its number.  Null ids and null texts hash as such; a null text has size 8.  The result depends on the rows, the
seed, the bucket size and the shard count, not on the cluster.  An empty table has no rows in any shard.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pacelane.llm.frames import settle, ship_package

BUCKET_BYTES = 8 << 20
MOST_BUCKETS = 1_000_000
GROUP_BITS = 12
GROUP = 1 << GROUP_BITS
OVERHEAD = 8
"""Bytes that a row counts besides its text."""


def row_size(text_column: str = "text") -> Column:
    return F.coalesce(F.octet_length(F.col(f"`{text_column}`")), F.lit(0)).cast("long") + OVERHEAD


def fisher_yates(count: int, rng: np.random.Generator) -> np.ndarray:
    """A random order of ``count`` rows: each place, from the last on, swaps with a random place not after it."""
    order = np.arange(count)
    picks = (rng.random(count) * np.arange(1, count + 1)).astype(np.int64)
    for k in range(count - 1, 0, -1):
        j = picks[k]
        order[k], order[j] = order[j], order[k]
    return order


def numbered_copies(rows: DataFrame) -> DataFrame:
    """``rows`` with ``__copy``, 0 to n - 1 among the n rows of a ``__ticket``; no task sees more than ``GROUP`` of them at once."""
    placed = settle(rows).withColumn("__place", F.monotonically_increasing_id())
    placed = placed.withColumn("__group", F.shiftright("__place", GROUP_BITS))
    sizes = placed.groupBy("__ticket", "__group").agg(F.count(F.lit(1)).alias("__size"))
    before = Window.partitionBy("__ticket").orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__ticket", "__group", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy("__ticket", "__group").orderBy("__place")
    numbered = placed.join(starts, ["__ticket", "__group"]).withColumn("__copy", F.col("__start") + F.row_number().over(within) - 1)
    return numbered.drop("__place", "__group", "__start")


def shuffled(df: DataFrame, shards: int, seed: int = 0, bucket_bytes: int = BUCKET_BYTES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``df`` with ``shard`` and ``slot``; columns of these names are replaced, all others stay."""
    ship_package(df.sparkSession)
    rows = df.drop("shard", "slot")
    total = rows.agg(F.sum(row_size(text_column))).first()[0] or 0
    buckets = min(MOST_BUCKETS, max(1, -(-total // bucket_bytes)))
    ticket = F.xxhash64(F.lit(seed), F.col(f"`{id_column}`"), F.col(f"`{text_column}`"))
    bucket = F.pmod("__ticket", F.lit(buckets)).cast("int").alias("__bucket")
    dealt = rows.withColumn("__ticket", ticket).select("*", bucket)
    found = dealt.groupBy("__bucket").agg(F.count(F.lit(1)), F.sum(row_size(text_column))).collect()  # one row per bucket
    counts = {b: n for b, n, _ in found}
    full = [b for b, n, size in found if n > 1 and size > 2 * bucket_bytes]
    if full:
        inside = dealt.where(F.col("__bucket").isin(full)).groupBy("__ticket").agg(F.count(F.lit(1)).alias("n"), F.sum(row_size(text_column)).alias("size"))
        heavy = inside.where((F.col("n") > 1) & (F.col("size") > bucket_bytes)).select("__ticket")  # fewer than there are buckets
        if not heavy.isEmpty():
            heavy = F.broadcast(settle(heavy))
            copies = numbered_copies(dealt.join(heavy, "__ticket", "left_semi").drop("__bucket"))
            copies = copies.withColumn("__ticket", F.xxhash64("__ticket", "__copy")).drop("__copy").select("*", bucket)
            dealt = dealt.join(heavy, "__ticket", "left_anti").unionByName(copies).select(*dealt.columns)
            counts = dict(map(tuple, dealt.groupBy("__bucket").count().collect()))
    starts, at = {}, 0
    for bucket in sorted(counts):
        starts[bucket] = at
        at += counts[bucket]
    offsets = np.array([starts.get(b, 0) for b in range(buckets)], np.int64)
    place = rows.columns.index(id_column)

    def shuffle(table: pa.Table) -> pa.Table:
        number = table.column("__bucket")[0].as_py()
        first = pa.table({"ticket": table.column("__ticket"), "id": table.column(place)})
        fixed = pc.sort_indices(first, sort_keys=[("ticket", "ascending"), ("id", "ascending")])
        order = fisher_yates(len(table), np.random.default_rng([seed, number]))
        out = table.drop_columns(["__ticket", "__bucket"]).take(fixed.take(pa.array(order)))
        position = offsets[number] + np.arange(len(out))
        return out.append_column("shard", pa.array((position % shards).astype(np.int32))).append_column("slot", pa.array(position // shards))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return dealt.groupBy("__bucket").applyInArrow(shuffle, f"{kinds}, shard int, slot long")


def write_shards(df: DataFrame, path: str, shards: int, **options) -> None:
    """Write each shard to a folder of its own under ``path``; ``slot`` tells the order inside."""
    shuffled(df, shards, **options).write.partitionBy("shard").mode("overwrite").parquet(path)
