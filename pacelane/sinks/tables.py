"""Writers: canonical streams, quarantine, derived series, serving exports and marts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pacelane.operators.clean import iso_text

from pacelane.operators.ordered import chunk_number

CODEC = "zstd"


def write_stream(df: DataFrame, path: str, *, time: str = "t_rel_ns", slice_ns: int = 3_600_000_000_000, partitions: Sequence[str] = ("dataset_id", "modality", "session_id"), mode: str = "append") -> None:
    """Canonical rows to Parquet by dataset, modality and session, sorted by stream and time.

    The shuffle key includes a time slice, so a session with very many rows is
    written by several tasks; row groups stay sorted, which lets time filters skip.
    """
    sliced = df.withColumn("__slice", chunk_number(time, slice_ns))
    order = [*partitions, "stream_id", time]
    sliced.repartition(*partitions, "stream_id", "__slice").sortWithinPartitions(*order).drop("__slice").write.partitionBy(*partitions).option("compression", CODEC).mode(mode).parquet(path)


def write_quarantine(df: DataFrame, path: str, rule: str = "rule", mode: str = "append") -> None:
    """Rejected rows, one folder per rule; several files per rule when there are many rows."""
    df.filter(F.col(rule).isNotNull()).write.partitionBy(rule).option("compression", CODEC).mode(mode).parquet(path)


def write_series(df: DataFrame, path: str, *, algorithm_id: str, parameters_hash: str, series: str) -> None:
    """Derived series under its deterministic key; a rerun replaces only that key."""
    keyed = df.withColumns({"algorithm_id": F.lit(algorithm_id), "parameters_hash": F.lit(parameters_hash), "series": F.lit(series)})
    keyed.write.partitionBy("algorithm_id", "parameters_hash", "series").option("partitionOverwriteMode", "dynamic").option("compression", CODEC).mode("overwrite").parquet(path)


def serving_form(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, dates and timestamps as ISO text."""
    out: list[Column] = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind.startswith(("struct", "array", "map")):
            c = F.to_json(c, {"ignoreNullFields": "false"})
        elif kind == "date":
            c = F.date_format(c, "yyyy-MM-dd")
        elif kind.startswith("timestamp"):
            c = iso_text(name)
        out.append(c.alias(name))
    return df.select(*out)


def export_serving(tables: Mapping[str, tuple[DataFrame, Sequence[str]]], path: str) -> None:
    """Each table in primary-key order; the sort is a range shuffle, not one task."""
    for name, (df, key) in tables.items():
        serving_form(df).orderBy(*key).write.option("compression", CODEC).mode("overwrite").parquet(f"{path}/{name}")


def unpublishable_runs(runs: DataFrame) -> DataFrame:
    """Processor runs without a code revision; publishing is refused while any exist."""
    return runs.filter((F.col("origin") == "processor") & (F.coalesce(F.trim("code_sha"), F.lit("")) == "")).select("run_id")


def publish_marts(marts: Mapping[str, DataFrame], runs: DataFrame, path: str, *, allow_unknown_code: bool = False) -> None:
    """Replace every mart, or none when a run lacks its code revision."""
    if not allow_unknown_code and not unpublishable_runs(runs).isEmpty():
        raise ValueError("a processor run has no code revision; marts stay as they are")
    for name, df in marts.items():
        df.write.option("compression", CODEC).mode("overwrite").parquet(f"{path}/{name}")
