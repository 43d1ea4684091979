"""Paired comparison, distributions and headline summaries of served metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pacelane.operators import ranking


def pair_metrics(rows: DataFrame, first: str, second: str, identity: Sequence[str], unit: str = "si_unit") -> DataFrame:
    """Values of two metrics on the same full identity; a key that is not unique on a side pairs nothing.

    NULL parts of an identity are equal to each other.
    """
    side = lambda name, tag: (
        rows.filter(F.col("metric_id") == name)
        .groupBy(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in identity])
        .agg(F.count(F.lit(1)).alias("n"), F.min("value_num").alias(tag), F.min(unit).alias(f"unit_{tag}"))
        .filter(f"n = 1 AND {tag} IS NOT NULL")
        .drop("n")
    )
    return side(first, "a").join(side(second, "b"), list(identity)).withColumn("same_unit", F.col("unit_a") == F.col("unit_b"))


def paired_comparison(pairs: DataFrame, keys: Sequence[str], a: str, b: str, tolerance: float | None = None) -> DataFrame:
    """Bias, error sizes, concordance and correlation of pairs; undefined ratios are NULL."""
    d = F.col(a) - F.col(b)
    close = F.lit(None).cast("bigint") if tolerance is None else F.count_if(F.abs(d) <= tolerance)
    grouped = pairs.groupBy(*keys) if keys else pairs
    out = grouped.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(d).alias("bias"),
        F.avg(F.abs(d)).alias("mae"),
        F.sqrt(F.avg(d * d)).alias("rmse"),
        F.max(F.abs(d)).alias("max_abs_error"),
        F.avg(a).alias("mean_a"),
        F.avg(b).alias("mean_b"),
        F.var_pop(a).alias("__va"),
        F.var_pop(b).alias("__vb"),
        F.covar_pop(a, b).alias("__c"),
        close.alias("within_tolerance"),
    )
    gap = F.col("mean_a") - F.col("mean_b")
    spread = F.col("__va") + F.col("__vb") + gap * gap
    return out.withColumns(
        {
            "ccc": F.when(spread > 0, 2 * F.col("__c") / spread),
            "pearson_r": F.when((F.col("__va") > 0) & (F.col("__vb") > 0), F.col("__c") / F.sqrt(F.col("__va") * F.col("__vb"))),
        }
    ).drop("__va", "__vb", "__c")


def bland_altman(pairs: DataFrame, keys: Sequence[str], a: str, b: str, *, z: float = 1.96, min_pairs: int = 30) -> DataFrame:
    """Limits of agreement; NULL below the smallest number of pairs."""
    d = F.col(a) - F.col(b)
    grouped = pairs.groupBy(*keys) if keys else pairs
    out = grouped.agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("__m"), F.stddev_pop(d).alias("__s"))
    ok = (F.col("n") >= min_pairs) & (F.col("n") >= 2)
    keep = lambda c: F.when(ok, c)
    return out.select(
        *keys, "n", keep(F.col("__m")).alias("mean_difference"), keep(F.col("__s")).alias("sd_difference"), keep(F.col("__m") - z * F.col("__s")).alias("lower_limit"), keep(F.col("__m") + z * F.col("__s")).alias("upper_limit")
    )


def difference_summary(pairs: DataFrame, keys: Sequence[str], a: str, b: str, *, min_pairs: int = 3, bias_correlation: float = 0.5) -> DataFrame:
    """Spread of b - a; limits are flagged as unusable when the difference grows with the magnitude."""
    d, m = F.col(b) - F.col(a), (F.col(a) + F.col(b)) / 2
    grouped = pairs.withColumns({"__d": d, "__m": m}).groupBy(*keys) if keys else pairs.withColumns({"__d": d, "__m": m})
    out = grouped.agg(
        F.count(F.lit(1)).alias("count"), F.avg("__d").alias("mean_difference"), F.stddev_samp("__d").alias("__s"), F.var_pop("__d").alias("__vd"), F.var_pop("__m").alias("__vm"), F.covar_pop("__d", "__m").alias("__c")
    ).filter(F.col("count") >= min_pairs)
    r = F.when((F.col("__vd") > 0) & (F.col("__vm") > 0), F.col("__c") / F.sqrt(F.col("__vd") * F.col("__vm")))
    return out.select(
        *keys,
        "count",
        "mean_difference",
        (F.col("mean_difference") - 1.96 * F.col("__s")).alias("lower_limit"),
        (F.col("mean_difference") + 1.96 * F.col("__s")).alias("upper_limit"),
        r.alias("bias_correlation"),
        F.coalesce(F.abs(r) >= bias_correlation, F.lit(False)).alias("proportional_bias"),
    )


def five_number(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Minimum, quartiles, maximum and count of the values of each group."""
    return ranking.quantiles(rows, keys, value, {"minimum": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "maximum": 1.0})


# Metrics a session leads with, in order of preference, and the zone family.
HEADLINE_PREFERENCE = ("locomotor.distance_total", "cmj.jump_height_jhwd", "gymaware_mean_power", "gymaware_mean_force", "locomotor.max_speed")
ZONE_PREFIX, ZONE_ORDER = "locomotor.distance_zone.", ("low", "medium", "high")


def headline_metric(rows: DataFrame, keys: Sequence[str], preference: Sequence[str] = HEADLINE_PREFERENCE) -> DataFrame:
    """Preferred metric that is present, else the one with most values, then the smaller id."""
    counts = rows.groupBy(*keys, "metric_id").agg(F.count("value_num").alias("values"))
    place = F.array_position(F.array(*[F.lit(p) for p in preference]), F.col("metric_id"))
    order = F.struct(F.when(place > 0, place).otherwise(len(preference) + 1), F.when(place > 0, 0).otherwise(-F.col("values")), F.col("metric_id"))
    usable = counts.filter((place > 0) | (F.col("values") > 0))
    return usable.groupBy(*keys).agg(F.min_by(F.struct("metric_id", "values"), order).alias("__h")).select(*keys, F.col("__h.metric_id").alias("headline_metric_id"), F.col("__h.values").alias("values"))


def discriminating_field(rows: DataFrame, keys: Sequence[str], fields: Sequence[str] = ("entity_id", "subject_id", "trial_id")) -> DataFrame:
    """The identity column with most distinct values; the first listed wins a tie."""
    counts = rows.groupBy(*keys).agg(*[F.countDistinct(F.when(F.col(f) != "", F.col(f))).alias(f) for f in fields])
    best = F.array_max(F.array(*[F.struct(F.col(f).alias("n"), F.lit(-i).alias("o"), F.lit(f).alias("field")) for i, f in enumerate(fields)]))
    return counts.select(*keys, F.when(best["n"] > 0, best["field"]).otherwise(fields[0]).alias("field"))


def rank_metric(rows: DataFrame, keys: Sequence[str], entity: str, value: str = "value_num") -> DataFrame:
    """Entities of each metric from the largest value down; equal values share their rank."""
    present = rows.filter(F.col(value).isNotNull() & F.col(entity).isNotNull()).select(*keys, entity, F.col(value).alias("value"))
    return ranking.rank_within(present, keys, "value").select(*keys, entity, "value", "rank")


def zone_breakdown(rows: DataFrame, keys: Sequence[str], entity: str, prefix: str = ZONE_PREFIX, order: Sequence[str] = ZONE_ORDER) -> DataFrame:
    """One row per entity with a column per zone, only where every zone of the family is served."""
    zones = rows.filter(F.col("metric_id").isin([prefix + z for z in order]) & F.col("value_num").isNotNull())
    pick = lambda z: F.max(F.when(F.col("metric_id") == prefix + z, F.col("value_num"))).alias(z)
    wide = zones.groupBy(*keys, entity).agg(*[pick(z) for z in order])
    served = zones.groupBy(*keys).agg(F.countDistinct("metric_id").alias("__zones")).filter(F.col("__zones") == len(order)).drop("__zones")
    total = sum((F.coalesce(F.col(z), F.lit(0.0)) for z in order), F.lit(0.0))
    return wide.join(served, list(keys)).withColumn("total", total)


def source_metric_lookup(rows: DataFrame, key: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Reference values per trial or stream key, one column per metric."""
    return rows.groupBy(*key).pivot("metric_id", list(metrics)).agg(F.max("value_num"))


def profile_table(df: DataFrame) -> DataFrame:
    """Per column: rows, nulls, distinct values, smallest and largest as text.

    One aggregate reads the table once; the result is turned into one row per column.
    """
    picks = []
    for c in df.columns:
        text = F.col(c).cast("string")
        picks += [F.count_if(F.col(c).isNull()).alias(f"n_{c}"), F.countDistinct(c).alias(f"d_{c}"), F.min(text).alias(f"lo_{c}"), F.max(text).alias(f"hi_{c}")]
    wide = df.agg(F.count(F.lit(1)).alias("rows"), *picks)
    items = [F.struct(F.lit(c).alias("column"), F.col(f"n_{c}").alias("nulls"), F.col(f"d_{c}").alias("distinct_values"), F.col(f"lo_{c}").alias("minimum"), F.col(f"hi_{c}").alias("maximum")) for c in df.columns]
    return wide.select("rows", F.inline(F.array(*items)))


def structure_counts(df: DataFrame, section: Column, attributes: Sequence[str]) -> DataFrame:
    """Rows and presence of each attribute per section of a source."""
    return df.groupBy(section.alias("section")).agg(F.count(F.lit(1)).alias("rows"), *[F.count(a).alias(a) for a in attributes])
