"""Exact ranks and quantiles without sorting a whole group in one task.

Equal values are counted before any shuffle of rows, so a value shared by a third
of the table is one row.  Distinct values are spread over a grid between the
group's minimum and maximum and accumulated chunk by chunk.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pacelane.functions.scalar import is_finite
from pacelane.operators import ordered
from pacelane.session import settle

GRID = 1_000_000
CELLS_PER_CHUNK = 2_000
PARTS = 64


def distribution(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row per distinct finite value: its count and how many rows are at or below it."""
    keys = list(keys)
    counts = df.filter(is_finite(value)).groupBy(*keys, F.col(value).cast("double").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    cuts = F.percentile_approx("value", [k / PARTS for k in range(1, PARTS)], 10 * PARTS).alias("__cuts")
    ends = counts.groupBy(*keys).agg(F.min("value").alias("minimum"), F.max("value").alias("maximum"), F.sum("n").alias("valid_n"), cuts)
    # Approximate cuts depend on the order in which partial results meet, and the plan reads them twice (chunk sums and rows):
    # they are written once, so both readings place a value in the same cell.
    ends = settle(ends)
    joined = ordered.attach(counts, ends, keys, "value") if keys else counts.join(F.broadcast(ends))  # one row
    # The cuts hold about as many distinct values each, wherever outliers lie; inside a cut values go on an even grid.
    joined = joined.withColumn("__cut", F.size(F.filter("__cuts", lambda c: c <= F.col("value"))))
    low = F.coalesce(F.get("__cuts", F.col("__cut") - 1), F.col("minimum"))
    width = F.coalesce(F.get("__cuts", "__cut"), F.col("maximum")) - low
    cell = F.when(width > 0, F.floor((F.col("value") - low) / width * (GRID // PARTS))).otherwise(0).cast("bigint")
    placed = joined.withColumn("__place", F.col("__cut").cast("bigint") * (GRID // PARTS + 1) + cell).drop("__cuts", "__cut")
    partition = keys if keys else ["__all"]
    if not keys:
        placed = placed.withColumn("__all", F.lit(0))
    out = ordered.running(placed, partition, ["__place", "value"], chunk=CELLS_PER_CHUNK, sums={"at_or_below": F.col("n")})
    return out.drop("__place", "__all")


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probabilities: Mapping[str, float]) -> DataFrame:
    """Linearly interpolated quantiles per group, one named column each, plus ``valid_n``."""
    return quantiles_of(distribution(df, keys, value), keys, probabilities)


def quantiles_of(table: DataFrame, keys: Sequence[str], probabilities: Mapping[str, float]) -> DataFrame:
    keys = list(keys)
    first = F.col("at_or_below") - F.col("n")
    picks = []
    for name, p in probabilities.items():
        position = (F.col("valid_n") - 1) * F.lit(float(p))
        low, high = F.floor(position), F.ceil(position)
        holds = lambda i: (first <= i) & (i < F.col("at_or_below"))
        picks += [
            F.max(F.when(holds(low), F.col("value"))).alias(f"__lo_{name}"),
            F.max(F.when(holds(high), F.col("value"))).alias(f"__hi_{name}"),
            F.max(position - low).alias(f"__at_{name}"),
        ]
    grouped = table.groupBy(*keys).agg(F.max("valid_n").alias("valid_n"), *picks)
    out = [
        (F.col(f"__lo_{n}") + (F.col(f"__hi_{n}") - F.col(f"__lo_{n}")) * F.col(f"__at_{n}")).alias(n) for n in probabilities
    ]
    return grouped.select(*keys, "valid_n", *out)


def rank_within(df: DataFrame, keys: Sequence[str], value: str, *, targets: DataFrame | None = None) -> DataFrame:
    """Rank (ties share the best), inclusive percentile and the group's min, median, max.

    ``targets`` may hold rows to rank inside the population without belonging to it;
    by default the population ranks itself.
    """
    keys = list(keys)
    whole = settle(distribution(df, keys, value))
    middle = quantiles_of(whole, keys, {"median": 0.5}).drop("valid_n")
    table = whole.select(*keys, F.col("value").alias("__v"), "at_or_below", "valid_n", "minimum", "maximum")
    rows = (df if targets is None else targets).withColumn("__own", F.when(is_finite(value), F.col(value).cast("double")))
    population = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("population_n"))
    whole_row = F.xxhash64(*rows.columns)
    if targets is None:
        steps = table.select(*keys, F.col("__v").alias("__own"), "at_or_below")
        ranked = rows.join(steps, [*keys, "__own"], "left")
    else:
        # A value between two population values is carried down from the one below it.
        ours = rows.select(*keys, "__own").filter("__own IS NOT NULL").distinct()
        merged = ours.withColumn("__seen", F.lit(None).cast("bigint")).unionByName(
            table.select(*keys, F.col("__v").alias("__own"), F.col("at_or_below").alias("__seen"))
        )
        combined = settle(merged.groupBy(*keys, "__own").agg(F.max("__seen").alias("__seen")))
        span = combined.groupBy(*keys).agg(F.min("__own").alias("__lo"), F.max("__own").alias("__hi"))
        spread = (ordered.attach(combined, span, keys, "__own") if keys else combined.join(F.broadcast(span))).withColumn(
            "__place", F.when(F.col("__hi") > F.col("__lo"), F.floor((F.col("__own") - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * GRID)).otherwise(0).cast("bigint")
        )
        known = ordered.running(spread, keys, ["__place", "__own"], chunk=CELLS_PER_CHUNK, lasts={"at_or_below": F.col("__seen")})
        ranked = rows.join(known.select(*keys, "__own", F.coalesce("at_or_below", F.lit(0)).alias("at_or_below")), [*keys, "__own"], "left")
    ends = table.groupBy(*keys).agg(F.max("valid_n").alias("valid_n"), F.max("minimum").alias("minimum"), F.max("maximum").alias("maximum"))
    out = ordered.attach(ranked, population.join(ends, keys, "left").join(middle, keys, "left"), keys, whole_row, "left")
    has = F.col("__own").isNotNull() & F.col("valid_n").isNotNull()
    return out.withColumns(
        {
            "valid_n": F.coalesce("valid_n", F.lit(0).cast("bigint")),
            "rank": F.when(has, F.col("valid_n") - F.col("at_or_below") + 1),
            "percentile": F.when(has, F.bround(F.lit(100.0) * F.col("at_or_below") / F.col("valid_n"), 1)),
        }
    ).drop("__own", "at_or_below")
