"""Bounded reads over dense series: windows, envelopes, entities and pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Columns that identify an entity, first one present wins.
ENTITY_COLUMNS = ("object_id", "subject_id", "entity_id")


def entity_column(df: DataFrame) -> str | None:
    return next((c for c in ENTITY_COLUMNS if c in df.columns), None)


def entity_filter(df: DataFrame, entity) -> DataFrame:
    """Rows of one entity; a table without an entity column cannot be scoped to one."""
    if entity is None:
        return df
    column = entity_column(df)
    if column is None:
        raise ValueError("this table declares no entity column")
    return df.filter(F.col(column) == F.lit(entity))


def scan_stream(df: DataFrame, from_ns: int, to_ns: int, columns: Sequence[str] = (), entity=None, *, time: str = "t_rel_ns") -> DataFrame:
    """Closed time window with chosen columns; both reach the Parquet scan."""
    unknown = sorted(set(columns) - set(df.columns))
    if unknown:
        raise ValueError(f"requested columns are absent: {unknown}")
    window = entity_filter(df, entity).filter(F.col(time).between(from_ns, to_ns))
    return window.select(*columns) if columns else window


def window_rows(df: DataFrame, from_ns: int, to_ns: int, entity=None, *, time: str = "t_rel_ns") -> DataFrame:
    return scan_stream(df, from_ns, to_ns, (), entity, time=time).agg(F.count(F.lit(1)).alias("rows"))


def bounded_window(df: DataFrame, from_ns: int, to_ns: int, *, max_rows: int, columns: Sequence[str] = (), entity=None, time: str = "t_rel_ns") -> DataFrame:
    """The window itself, refused while planning when it holds more rows than allowed."""
    rows = window_rows(df, from_ns, to_ns, entity, time=time).first()["rows"]
    if rows > max_rows:
        raise ValueError(f"window holds {rows} rows, more than {max_rows}")
    return scan_stream(df, from_ns, to_ns, columns, entity, time=time)


def timespan(df: DataFrame, time: str = "t_rel_ns") -> DataFrame:
    return df.agg(F.min(time).alias("first_ns"), F.max(time).alias("last_ns"))


def envelope(df: DataFrame, identity: Sequence[str], measures: Sequence[str], from_ns: int, to_ns: int, max_points: int, *, time: str = "t_rel_ns") -> DataFrame:
    """Minimum and maximum per time bucket and identity.

    The point budget is shared by the identities seen in the window, and one extra
    nanosecond of span keeps the last sample inside the last bucket.
    """
    if max_points < 1:
        raise ValueError("max_points must be at least 1")
    window = scan_stream(df, from_ns, to_ns, time=time)
    span = max(1, to_ns - from_ns + 1)
    if identity:
        seen = window.select(*identity).distinct().agg(F.greatest(F.count(F.lit(1)), F.lit(1).cast("bigint")).alias("__ids"))
        window = window.join(F.broadcast(seen))  # one row
        share = F.greatest(F.call_function("div", F.lit(max_points).cast("bigint"), F.col("__ids")), F.lit(1).cast("bigint"))
    else:
        share = F.lit(max_points).cast("bigint")
    width = F.call_function("div", F.lit(span).cast("bigint") + share - 1, share)
    bucketed = window.withColumn("bucket", F.call_function("div", F.col(time) - F.lit(from_ns), width))
    extremes = [f(m).alias(f"{m}_{n}") for m in measures for f, n in ((F.min, "min"), (F.max, "max"))]
    return bucketed.groupBy(*identity, "bucket").agg(F.min(time).alias("t_start_ns"), F.max(time).alias("t_end_ns"), F.count(F.lit(1)).alias("bucket_rows"), *extremes)


def entity_count(df: DataFrame) -> DataFrame:
    return df.agg(F.countDistinct(entity_column(df)).alias("entities"))


def entity_list(df: DataFrame) -> DataFrame:
    column = entity_column(df)
    return df.select(F.col(column).cast("string").alias("entity_id")).filter("entity_id IS NOT NULL").distinct()


def entity_observations(df: DataFrame, usable: Column, *, time: str = "t_rel_ns") -> DataFrame:
    """First and last usable time and number of distinct frames per entity."""
    column = entity_column(df)
    return df.filter(usable & F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("entity_id")).agg(
        F.min(time).alias("first_observed_ns"), F.max(time).alias("last_observed_ns"), F.countDistinct(time).alias("observation_count")
    )


def list_streams(streams: DataFrame, *, dataset_id: str | None = None, modality: str | None = None, session_id: str | None = None) -> DataFrame:
    """Registered streams in deterministic order."""
    for name, wanted in (("dataset_id", dataset_id), ("modality", modality), ("session_id", session_id)):
        if wanted is not None:
            streams = streams.filter(F.col(name) == wanted)
    return streams.orderBy("dataset_id", "session_id", "stream_id")


def metric_filter(metrics: DataFrame, **wanted: str | None) -> DataFrame:
    for name, value in wanted.items():
        if value is not None:
            metrics = metrics.filter(F.col(name) == value)
    return metrics
