"""Incremental forms of the checks, segments, envelopes, links and duplicate removal."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pacelane.operators import ordered


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A growing folder of Parquet files as a stream; the schema is read once, not inferred per file."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def run_available(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Process everything available once into Parquet and read it back."""
    schema = stream.schema
    stream.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(schema).parquet(f"{path}/out")


def live_segments(stream: DataFrame, keys: Sequence[str], time: str, gap: str, delay: str) -> DataFrame:
    """Stretches of samples with no step longer than the gap, emitted once they can no longer grow."""
    session = F.session_window(time, gap)
    grouped = stream.withWatermark(time, delay).groupBy(*keys, session.alias("w")).agg(F.count(F.lit(1)).alias("samples"))
    # The window closes one gap after its last sample.
    return grouped.select(*keys, F.col("w.start").alias("segment_start"), (F.col("w.end") - F.expr(f"INTERVAL {gap}")).alias("segment_last"), "samples")


def live_envelope(stream: DataFrame, keys: Sequence[str], time: str, bucket: str, delay: str, measures: Sequence[str]) -> DataFrame:
    """Minimum and maximum per time bucket and entity, emitted when the bucket is complete."""
    extremes = [f(m).alias(f"{m}_{n}") for m in measures for f, n in ((F.min, "min"), (F.max, "max"))]
    grouped = stream.withWatermark(time, delay).groupBy(*keys, F.window(time, bucket).alias("w")).agg(F.count(F.lit(1)).alias("bucket_rows"), *extremes)
    return grouped.select(*keys, F.col("w.start").alias("bucket_start"), "bucket_rows", *[c for c in grouped.columns if c not in (*keys, "w", "bucket_rows")])


def live_event_join(events: DataFrame, frames: DataFrame, keys: Sequence[str], event_time: str, frame_time: str, delay: str, reach: str) -> DataFrame:
    """Events linked to frames with the same key that arrive within ``reach``; state older than that is dropped."""
    left = events.withWatermark(event_time, delay)
    right = frames.withWatermark(frame_time, delay).withColumnsRenamed({k: f"__{k}" for k in keys})
    on: Column = F.lit(True)
    for k in keys:
        on = on & (F.col(k) == F.col(f"__{k}"))
    span = F.expr(f"INTERVAL {reach}")
    near = (F.col(frame_time) >= F.col(event_time) - span) & (F.col(frame_time) <= F.col(event_time) + span)
    return left.join(right, on & near, "inner").drop(*[f"__{k}" for k in keys])


def live_dedupe(stream: DataFrame, identity: Sequence[str], time: str, delay: str) -> DataFrame:
    """First sighting of each identity; its state is dropped after the delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(identity))


# -- incremental validation ---------------------------------------------------------------

STATE = "stream_id string, last_index bigint, last_t bigint, rows bigint, violations bigint"


def validate_batch(batch: DataFrame, state: DataFrame, *, strict: bool, chunk: int = 100_000) -> DataFrame:
    """New state per stream after a batch: rows so far and order violations so far.

    The last sample of the state stands in front of the batch as one more row, so a
    violation across batches is seen; the batch itself is checked chunk by chunk.
    """
    rows = batch.select("stream_id", "sample_index", "t_rel_ns", F.lit(0).alias("__old"))
    carried = state.filter("last_index IS NOT NULL").select("stream_id", F.col("last_index").alias("sample_index"), F.col("last_t").alias("t_rel_ns"), F.lit(1).alias("__old"))
    both = rows.unionByName(carried).withColumn("__first", 1 - F.col("__old"))

    def stage(w):
        step = F.col("t_rel_ns") - F.lag("t_rel_ns").over(w)
        late = step <= 0 if strict else step < 0
        repeated = F.col("sample_index") <= F.lag("sample_index").over(w)
        return {"__bad": F.coalesce(late, F.lit(False)) | F.coalesce(repeated, F.lit(False))}

    marked = ordered.stencil(both, ["stream_id"], ["sample_index", "__first", "t_rel_ns"], stage, ahead=0, chunk=chunk)
    now = marked.groupBy("stream_id").agg(
        F.max(F.struct("sample_index", "t_rel_ns")).alias("__last"), F.count_if(F.col("__old") == 0).alias("__rows"), F.count_if("__bad").alias("__bad")
    )
    merged = now.join(state, "stream_id", "full_outer")
    zero = F.lit(0).cast("bigint")
    return merged.select(
        "stream_id",
        F.coalesce("__last.sample_index", "last_index").alias("last_index"),
        F.coalesce("__last.t_rel_ns", "last_t").alias("last_t"),
        (F.coalesce("rows", zero) + F.coalesce("__rows", zero)).alias("rows"),
        (F.coalesce("violations", zero) + F.coalesce("__bad", zero)).alias("violations"),
    )


def _last_epoch(spark: SparkSession, path: str) -> int:
    """Newest epoch that earlier runs have stored; -1 if there is none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return -1
    names = [status.getPath().getName() for status in files.listStatus(folder)]
    return max([int(n.split("=")[1]) for n in names if n.startswith("epoch=")], default=-1)


def validate_stream(stream: DataFrame, path: str, *, strict: bool, prepare: Callable[[DataFrame], DataFrame] = lambda df: df, chunk: int = 100_000) -> DataFrame:
    """Validate a stream batch by batch; the state is a small table per epoch in the shared folder.

    A batch that is run again after a failure reads the same earlier state and
    overwrites its own, so counts stay exact.
    """
    spark = stream.sparkSession

    def state_of(epoch: int) -> DataFrame:
        return spark.createDataFrame([], STATE) if epoch < 0 else spark.read.schema(STATE).parquet(f"{path}/state/epoch={epoch}")

    def step(batch: DataFrame, epoch: int) -> None:
        validate_batch(prepare(batch), state_of(epoch - 1), strict=strict, chunk=chunk).write.mode("overwrite").parquet(f"{path}/state/epoch={epoch}")
        last[0] = epoch

    last = [_last_epoch(spark, f"{path}/state")]
    stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return state_of(last[0])
