"""Current revisions, upserts, fingerprints and the serving marts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OWNER = ["subject_id", "session_id", "trial_id", "stream_id"]


def with_provenance(metrics: DataFrame, names: Sequence[str] = ("algorithm_id", "entity_id")) -> DataFrame:
    """Provenance JSON fields as columns, parsed once."""
    schema = ", ".join(f"{n} string" for n in names)
    return metrics.withColumn("__p", F.from_json("provenance", schema)).select("*", *[F.col(f"__p.{n}").alias(n) for n in names]).drop("__p")


def _filled(df: DataFrame, names: Sequence[str]) -> list[Column]:
    return [F.coalesce(F.col(n).cast("string"), F.lit("")).alias(f"__k_{n}") for n in names if n in df.columns]


def current_revision(metrics: DataFrame, row_id: str = "derived_metric_id") -> DataFrame:
    """Newest row per identity that also belongs to the newest run of its scope.

    Newest means latest computed_at (missing sorts oldest), then larger run id.
    Both choices are partial aggregates, so an identity or scope with very many
    revisions never gathers in one task.
    """
    age = F.struct(F.col("computed_at"), F.col("run_id"))
    owner = _filled(metrics, OWNER)
    identity = [F.col("dataset_id").alias("__k_dataset"), F.col("metric_id").alias("__k_metric"), *owner, F.coalesce("entity_id", F.lit("")).alias("__k_entity")]
    newest = metrics.groupBy(*identity).agg(F.max_by(F.struct(*metrics.columns), F.struct(age, F.col(row_id))).alias("__row")).select("__row.*")
    scope = [F.col("dataset_id").alias("__k_dataset"), F.coalesce("algorithm_id", F.lit("")).alias("__k_algorithm"), *owner]
    runs = metrics.groupBy(*scope).agg(F.max(age).alias("__age")).select("*", F.col("__age.run_id").alias("__scope_run")).drop("__age")
    keys = [c for c in runs.columns if c.startswith("__k_")]
    keyed = newest.select("*", *scope)
    return keyed.join(runs, keys).filter(F.col("run_id") == F.col("__scope_run")).select(*metrics.columns)


def duplicate_identities(current: DataFrame) -> DataFrame:
    """Identities with more than one current row; empty when the revision rule holds."""
    keys = ["dataset_id", "metric_id", *[c for c in OWNER if c in current.columns], "entity_id"]
    return current.groupBy(*keys).agg(F.count(F.lit(1)).alias("duplicate_count")).filter("duplicate_count > 1")


def latest_run_rows(rows: DataFrame, scope: Sequence[str], completed: str, run: str = "run_id") -> DataFrame:
    """All rows of the most recently completed run of each scope."""
    newest = rows.groupBy(*scope).agg(F.max(F.struct(completed, run)).alias("__m")).select(*scope, F.col(f"__m.{run}").alias(run))
    return rows.join(newest, [*scope, run])


def metric_with_definition(current: DataFrame, definitions: DataFrame) -> DataFrame:
    return current.join(definitions, "metric_id", "left")


def pivot_metrics(rows: DataFrame, keys: Sequence[str], picks: Mapping[str, tuple[str, str]], count: str | None = None) -> DataFrame:
    """One row per key with the max or min of metrics chosen by exact id or prefix (``x.%``)."""
    columns = [F.count(F.lit(1)).alias(count)] if count else []
    for name, (how, metric) in picks.items():
        hit = F.col("metric_id").like(metric) if metric.endswith("%") else F.col("metric_id") == metric
        value = F.when(hit, F.col("value_num"))
        columns.append((F.max(value) if how == "max" else F.min(value)).alias(name))
    return rows.groupBy(*keys).agg(*columns)


def mart_provenance(current: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Per run: latest ids, first and last computation, metric and artifact counts."""
    counts = artifacts.groupBy("run_id").agg(F.count(F.lit(1)).alias("artifact_count"))
    runs = current.groupBy("run_id", "dataset_id", "algorithm_id").agg(
        F.min("computed_at").alias("first_computed_at"), F.max("computed_at").alias("last_computed_at"), F.count(F.lit(1)).alias("metric_count")
    )
    return runs.join(counts, "run_id", "left").withColumn("artifact_count", F.coalesce("artifact_count", F.lit(0).cast("bigint")))


# -- table updates --------------------------------------------------------------------


def insert_or_ignore(existing: DataFrame, incoming: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows to append: incoming keys not stored yet, the first of several incoming rows."""
    rest = [c for c in incoming.columns if c not in key]
    first = incoming.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(*key, "__r.*")
    return first.join(existing.select(*key), list(key), "left_anti").select(*incoming.columns)


def upsert_refresh(existing: DataFrame, incoming: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Stored table after an update in which the incoming row wins on its key."""
    both = existing.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)))
    rest = [c for c in existing.columns if c not in key]
    picked = both.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("__new", *order)).alias("__r"))
    return picked.select(*key, "__r.*").select(*existing.columns)


def replace_by_path(existing: DataFrame, incoming: DataFrame, path: Sequence[str] = ("dataset_id", "path")) -> DataFrame:
    """Stored table after all rows of every incoming path are replaced."""
    return existing.join(incoming.select(*path).distinct(), list(path), "left_anti").unionByName(incoming)


def definition_conflicts(existing: DataFrame, incoming: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Known ids that arrive with another unit, name or class, and which fields differ."""
    a, b = existing.alias("a"), incoming.alias("b")
    differs = F.array_compact(F.array(*[F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f)) for f in fields]))
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}")).select(F.col(f"a.{key}").alias(key), differs.alias("fields")).filter(F.size("fields") > 0).distinct()


def pending_inputs(streams: DataFrame, runs: DataFrame) -> DataFrame:
    """Streams without a completed run of the same algorithm and parameters over all their inputs."""
    done = runs.filter("status = 'completed'").select("stream_id", "algorithm_id", "parameters_hash", F.col("input_checksums").alias("__have"))
    joined = streams.join(done, ["stream_id", "algorithm_id", "parameters_hash"], "left")
    covered = F.col("__have").isNotNull() & (F.size(F.array_except("checksums", F.coalesce("__have", F.array().cast("array<string>")))) == 0)
    return joined.groupBy(*streams.columns).agg(F.bool_or(covered).alias("__done")).filter(~F.col("__done")).drop("__done")


def fingerprint(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Order-free content fingerprint: row count, hash sum and hash xor."""
    rest = [c for c in df.columns if c not in keys]
    hashed = df.select(*keys, F.xxhash64(F.to_json(F.struct(*sorted(rest)), {"ignoreNullFields": "false"})).alias("__h"))
    sums = [
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.col("__h").cast("decimal(38,0)")).cast("string").alias("hash_sum"),
        F.bit_xor("__h").alias("hash_xor"),
    ]
    return hashed.groupBy(*keys).agg(*sums) if keys else hashed.agg(*sums)
