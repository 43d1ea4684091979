"""Contract checks, grain checks and reconciliation; one pass per group of rules.

Row rules are counted in one aggregate per stream.  Only the order rule needs
neighbouring rows, and it uses the chunked stencil.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pacelane.functions.scalar import is_finite
from pacelane.operators import ordered
from pacelane.schema import MEASUREMENT_CLASSES, SI_UNITS, StreamContract, grain_columns


def schema_violations(actual: T.StructType, contract: StreamContract) -> list[tuple[str, str]]:
    """(rule, column) pairs of a table's schema against its contract."""
    have, want = {f.name: f for f in actual.fields}, {f.name: f for f in contract.fields.fields}
    out = [("schema.field.missing", n) for n in want if n not in have]
    out += [("schema.field.unexpected", n) for n in have if n not in want]
    for name in sorted(set(have) & set(want)):
        if have[name].dataType != want[name].dataType:
            out.append(("schema.field.type", name))
        if have[name].nullable and not want[name].nullable:
            out.append(("schema.field.nullability", name))
        unit, expected = have[name].metadata.get("si_unit"), want[name].metadata.get("si_unit")
        if unit != expected:
            out.append(("schema.metadata.units" if unit else "schema.metadata.missing", name))
        if unit is not None and unit not in SI_UNITS:
            out.append(("units.not_si", name))
        if unit is not None and not isinstance(have[name].dataType, T.NumericType):
            out.append(("units.non_numeric", name))
    return out


def check_schema(df: DataFrame, contract: StreamContract) -> DataFrame:
    """Schema violations of a table next to the number of rows they affect."""
    found = schema_violations(df.schema, contract)
    listed = [F.struct(F.lit(r).alias("rule"), F.lit(c).alias("column")) for r, c in found]
    items = F.array(*listed).cast("array<struct<rule: string, column: string>>")
    return df.agg(F.count(F.lit(1)).alias("rows")).select(F.inline(items), "rows")


def count_rules(df: DataFrame, keys: Sequence[str], rules: Mapping[str, Column]) -> DataFrame:
    """Violations per key and rule, counted in one aggregate; each rule is an aggregate expression."""
    grouped = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *[c.cast("bigint").alias(f"r{i}") for i, c in enumerate(rules.values())])
    items = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"r{i}").alias("violations")) for i, n in enumerate(rules)])
    return grouped.select(*keys, "rows", F.inline(items)).filter("violations > 0")


def several(column: str) -> Column:
    """1 when a column holds more than one value, without a distinct count."""
    return F.when(F.min(column) != F.max(column), 1).otherwise(0)


def counted(checks: Mapping[str, Column]) -> dict[str, Column]:
    """Row checks as rules: how many rows fail."""
    return {name: F.count_if(failed) for name, failed in checks.items()}


def identity_checks(contract: StreamContract, columns: Sequence[str]) -> dict[str, Column]:
    out = {f"identity.null:{n}": F.col(n).isNull() for n in ("dataset_id", "session_id", "stream_id") if n in columns}
    if contract.subject_required and "subject_id" in columns:
        out["identity.subject_required"] = F.col("subject_id").isNull()
    return out


def authority_checks(contract: StreamContract, columns: Sequence[str]) -> dict[str, Column]:
    out = {f"authority.null:{n}": F.col(n).isNull() for n in ("clock_id", "synchronization_spec_id") if n in columns}
    if contract.frame_required and "coordinate_frame_id" not in columns:
        out["authority.frame_missing_column"] = F.lit(True)
    elif contract.frame_required:
        out["authority.frame_required"] = F.col("coordinate_frame_id").isNull()
    return out


def single_values(contract: StreamContract, columns: Sequence[str]) -> dict[str, str]:
    """Rules that a stream breaks when a column holds several values: rule and column."""
    out = {f"identity.multiple:{n}": n for n in ("dataset_id", "session_id", "stream_id") if n in columns}
    out |= {f"authority.multiple:{n}": n for n in ("clock_id", "synchronization_spec_id") if n in columns}
    if contract.frame_required and "coordinate_frame_id" in columns:
        out["authority.frame_multiple"] = "coordinate_frame_id"
    return out


def force_checks(columns: Sequence[str]) -> dict[str, Column]:
    """A force row carries newtons or a body-weight ratio, never both and never neither."""
    newton, ratio = F.lit(False), F.lit(False)
    for name in ("force_x_n", "force_y_n", "force_z_n"):
        if name in columns:
            newton = newton | F.col(name).isNotNull()
    if "force_z_body_weight_ratio" in columns:
        ratio = F.col("force_z_body_weight_ratio").isNotNull()
    return {"force.payload.missing": ~newton & ~ratio, "force.payload.ambiguous": newton & ratio}


def force_rules(columns: Sequence[str]) -> dict[str, Column]:
    return counted(force_checks(columns))


def pose_checks() -> dict[str, Column]:
    """Coordinates exist exactly when the joint is available."""
    seen = F.coalesce("is_available", F.lit(False))
    axes = ("x_m", "y_m", "z_m")
    every = F.col("x_m").isNotNull() & F.col("y_m").isNotNull() & F.col("z_m").isNotNull()
    some = F.col("x_m").isNotNull() | F.col("y_m").isNotNull() | F.col("z_m").isNotNull()
    finite = F.lit(True)
    for a in axes:
        finite = finite & F.coalesce(is_finite(a), F.lit(False))
    error_ok = F.coalesce(is_finite("error_m") & (F.col("error_m") >= 0), F.lit(False))
    return {
        "pose.availability.null": F.col("is_available").isNull(),
        "pose.payload.missing_coordinates": seen & ~every,
        "pose.payload.unexpected_coordinates": ~seen & some,
        "pose.payload.non_finite": seen & ~finite,
        "pose.error.invalid": F.col("error_m").isNotNull() & ~error_ok,
    }


def pose_rules() -> dict[str, Column]:
    return counted(pose_checks())


def class_checks() -> dict[str, Column]:
    c = F.col("measurement_class")
    return {"measurement_class.illegal": c.isNotNull() & ~c.isin(*MEASUREMENT_CLASSES), "measurement_class.null": c.isNull()}


def row_checks(contract: StreamContract, columns: Sequence[str]) -> dict[str, Column]:
    """Every check of a contract that one row passes or fails by itself."""
    out = identity_checks(contract, columns) | authority_checks(contract, columns)
    if "measurement_class" in columns:
        out |= class_checks()
    if contract.modality == "force":
        out |= force_checks(columns)
    if contract.modality == "pose":
        out |= pose_checks()
    return out


def time_rules(df: DataFrame, keys: Sequence[str], *, strict: bool, chunk: int = 100_000) -> DataFrame:
    """NULL, order, origin and contiguity of sample index and time per stream, in sample order."""
    nulls = {f"time.null:{c}": F.count_if(F.col(c).isNull()) for c in ("sample_index", "t_rel_ns")}
    counted = count_rules(df, keys, nulls).drop("rows")
    known = df.filter("sample_index IS NOT NULL").select(*keys, "sample_index", "t_rel_ns")
    tied = known.withColumn("__tie", F.coalesce("t_rel_ns", F.lit(0).cast("bigint")))

    def stage(w):
        later = F.col("t_rel_ns") - F.lag("t_rel_ns").over(w)
        bad = later <= 0 if strict else later < 0
        return {"__t": F.coalesce(bad, F.lit(False)), "__i": F.coalesce(F.col("sample_index") <= F.lag("sample_index").over(w), F.lit(False))}

    marked = ordered.stencil(tied, keys, ["sample_index", "__tie"], stage, ahead=0, chunk=chunk)
    rules = {
        "time.monotonic:sample_index": F.count_if("__i"),
        "time.monotonic:t_rel_ns": F.count_if("__t"),
        "time.zero_based": F.when(F.min("sample_index") != 0, 1).otherwise(0),
        "time.contiguous": F.when(F.max("sample_index") != F.count(F.lit(1)) - 1, 1).otherwise(0),
    }
    return counted.unionByName(count_rules(marked, keys, rules).drop("rows"))


def validate(df: DataFrame, contract: StreamContract, keys: Sequence[str] = ("stream_id",), *, chunk: int = 100_000) -> DataFrame:
    """Every row rule of a contract: stream, rule and number of violations."""
    rules = counted(row_checks(contract, df.columns)) | {n: several(c) for n, c in single_values(contract, df.columns).items()}
    rules = {n: c for n, c in rules.items() if not any(n.endswith(f":{k}") for k in keys)}
    out = count_rules(df, keys, rules).drop("rows")
    if contract.dense:
        out = out.unionByName(time_rules(df, keys, strict=contract.strict_time, chunk=chunk))
    return out


def to_issues(violations: DataFrame, dataset_id: str, severity: str = "error") -> DataFrame:
    """Violations as quality issue rows with a stable id."""
    return violations.select(
        F.concat(F.lit("qi-"), F.substring(F.sha2(F.concat_ws("|", F.lit(dataset_id), F.col("stream_id"), F.col("rule")), 256), 1, 24)).alias("issue_id"),
        F.lit(dataset_id).alias("dataset_id"),
        "stream_id",
        "rule",
        F.lit(severity).alias("severity"),
        F.to_json(F.struct("violations")).alias("evidence_json"),
    )


def grain_check(df: DataFrame, kind: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Rows with a NULL axis and keys used more than once, for a declared grain."""
    keys = grain_columns(kind, df.columns, extra)
    empty = F.lit(False)
    for k in keys:
        empty = empty | F.col(k).isNull()
    # Counting per key first is a partial aggregate, so one key used very often is cheap.
    counted = df.select(*keys, empty.alias("__null")).groupBy(*keys, "__null").agg(F.count(F.lit(1)).alias("n"))
    return counted.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("rows"),
        F.coalesce(F.sum(F.when(F.col("__null"), F.col("n"))), F.lit(0)).cast("bigint").alias("null_key_rows"),
        F.count_if(~F.col("__null") & (F.col("n") > 1)).alias("duplicate_keys"),
    )


def session_participation(sessions: DataFrame, participants: DataFrame) -> DataFrame:
    """Sessions with too few subjects or a subject twice in the same role."""
    per_role = participants.groupBy("session_id", "subject_id", "role").agg(F.count(F.lit(1)).alias("n"))
    counts = per_role.groupBy("session_id").agg(F.countDistinct("subject_id").alias("subjects"), F.count_if(F.col("n") > 1).alias("duplicate_roles"))
    joined = sessions.join(counts, "session_id", "left").na.fill({"subjects": 0, "duplicate_roles": 0})
    needed = F.when(F.col("is_collective"), 2).otherwise(1)
    return joined.withColumn("too_few", F.col("subjects") < needed).filter("too_few OR duplicate_roles > 0").select("session_id", "subjects", "duplicate_roles", "too_few")


def table_tests(df: DataFrame, *, unique: Sequence[str] = (), not_null: Sequence[str] = (), accepted: Mapping[str, Sequence] | None = None, conditional: Mapping[str, tuple[str, str]] | None = None) -> DataFrame:
    """Mart tests: failing rows (or keys, for uniqueness) per test."""
    rules: dict[str, Column] = {f"not_null:{c}": F.count_if(F.col(c).isNull()) for c in not_null}
    for c, values in (accepted or {}).items():
        rules[f"accepted_values:{c}"] = F.count_if(F.col(c).isNotNull() & ~F.col(c).isin(*values))
    for name, (column, condition) in (conditional or {}).items():
        rules[f"conditional:{name}"] = F.count_if(F.expr(condition) & F.col(column).isNull())
    named = df.withColumn("__all", F.lit("table"))
    out = count_rules(named, ["__all"], rules).select("rule", "violations") if rules else None
    for c in unique:
        repeated = df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").agg(F.count(F.lit(1)).alias("violations"))
        part = repeated.filter("violations > 0").select(F.lit(f"unique:{c}").alias("rule"), "violations")
        out = part if out is None else out.unionByName(part)
    return out


def stream_reconciliation(source: DataFrame, canonical: DataFrame, quarantined: DataFrame, ignored: DataFrame, keys: Sequence[str] = ("stream_id",)) -> DataFrame:
    """Per stream: source rows must equal canonical plus quarantined plus ignored."""
    parts = {"source_records": source, "canonical_rows": canonical, "quarantined_rows": quarantined, "ignored_records": ignored}
    tagged = None
    for name, df in parts.items():
        counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit(name))
        tagged = counts if tagged is None else tagged.unionByName(counts)
    out = tagged.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(F.col("part") == p, F.col("n"))), F.lit(0)).cast("bigint").alias(p) for p in parts])
    return out.withColumn("balances", F.col("canonical_rows") + F.col("quarantined_rows") + F.col("ignored_records") == F.col("source_records"))
