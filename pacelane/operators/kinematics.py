"""Movement of tracked entities: steps, derivatives, gates, zones, efforts, rolling peaks.

Every function takes the key columns of one series (for instance stream and
entity) and order columns whose first is an integer time in ns.  Missing values
are NULL; nothing is filled or resampled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from pacelane.functions.scalar import SPHERE_RADIUS_M, haversine_m, is_finite, seconds
from pacelane.operators import ordered
from pacelane.session import settle

DEFAULT_CHUNK_NS = 600_000_000_000
OPEN_EDGE = "none"
ONE_SIDED_EDGE = "one_sided"


# -- stencils -----------------------------------------------------------------


def central_difference(window: WindowSpec, value: str | Column, time: str, edge: str = OPEN_EDGE) -> Column:
    """Derivative per second; NULL at both ends, or one-sided there when asked."""
    value = F.col(value) if isinstance(value, str) else value
    t = F.col(time)
    before, after = F.lag(t).over(window), F.lead(t).over(window)
    inner = (F.lead(value).over(window) - F.lag(value).over(window)) / seconds(after - before)
    if edge == OPEN_EDGE:
        return inner
    first = (F.lead(value).over(window) - value) / seconds(after - t)
    last = (value - F.lag(value).over(window)) / seconds(t - before)
    return F.when(before.isNull(), first).when(after.isNull(), last).otherwise(inner)


def sample_duration(window: WindowSpec, time: str) -> Column:
    """Trapezoidal time weight of a sample in seconds."""
    t = F.col(time)
    before, after = t - F.lag(t).over(window), F.lead(t).over(window) - t
    return F.when(before.isNull() & after.isNull(), 0.0).when(before.isNull(), seconds(after)).when(after.isNull(), seconds(before)).otherwise(seconds(before + after) / 2)


def step_length(window: WindowSpec, x: str, y: str, method: str = "planar", radius: float = SPHERE_RADIUS_M) -> Column:
    """Distance from the previous sample; for ``haversine`` x is latitude and y longitude."""
    px, py = F.lag(x).over(window), F.lag(y).over(window)
    first = F.lag(F.lit(1)).over(window).isNull()
    move = haversine_m(px, py, F.col(x), F.col(y), radius) if method == "haversine" else F.hypot(F.col(x) - px, F.col(y) - py)
    return F.when(first, 0.0).otherwise(move)


def spread(window: WindowSpec, flag: Column, radius: int = 1) -> Column:
    """True where the flag is true at most ``radius`` samples away."""
    out = F.coalesce(flag, F.lit(False))
    for shift in range(1, radius + 1):
        out = out | F.coalesce(F.lag(flag, shift).over(window), F.lit(False)) | F.coalesce(F.lead(flag, shift).over(window), F.lit(False))
    return out


def derivative(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str, *, edge: str = OPEN_EDGE, chunk: int | None = DEFAULT_CHUNK_NS) -> DataFrame:
    return ordered.stencil(df, keys, order, lambda w: {out: central_difference(w, value, order[0], edge)}, chunk=chunk)


def planar_speed(df: DataFrame, keys: Sequence[str], order: Sequence[str], x: str, y: str, *, edge: str = OPEN_EDGE, chunk: int | None = DEFAULT_CHUNK_NS) -> DataFrame:
    t = order[0]
    return ordered.stencil(
        df,
        keys,
        order,
        lambda w: {"vx_m_s": central_difference(w, x, t, edge), "vy_m_s": central_difference(w, y, t, edge)},
        lambda w: {"speed_m_s": F.hypot("vx_m_s", "vy_m_s")},
        chunk=chunk,
    )


def sample_durations(df: DataFrame, keys: Sequence[str], order: Sequence[str], *, chunk: int | None = DEFAULT_CHUNK_NS) -> DataFrame:
    return ordered.stencil(df, keys, order, lambda w: {"duration_s": sample_duration(w, order[0])}, chunk=chunk)


def dilate(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: str, out: str, *, radius: int = 1, chunk: int | None = DEFAULT_CHUNK_NS) -> DataFrame:
    return ordered.stencil(df, keys, order, lambda w: {out: spread(w, F.col(flag), radius)}, back=radius, ahead=radius, chunk=chunk)


def step_distance(df: DataFrame, keys: Sequence[str], order: Sequence[str], x: str, y: str, *, method: str = "planar", radius: float = SPHERE_RADIUS_M, chunk: int | None = DEFAULT_CHUNK_NS) -> DataFrame:
    return ordered.stencil(df, keys, order, lambda w: {"step_m": step_length(w, x, y, method, radius)}, ahead=0, chunk=chunk)


def path_length(df: DataFrame, keys: Sequence[str], order: Sequence[str], x: str, y: str, *, method: str = "planar", radius: float = SPHERE_RADIUS_M, chunk: int | None = DEFAULT_CHUNK_NS) -> DataFrame:
    """Step distance and the distance covered so far."""
    stepped = step_distance(df, keys, order, x, y, method=method, radius=radius, chunk=chunk)
    return ordered.running(stepped, keys, order, chunk=chunk, sums={"path_m": F.col("step_m")})


def cumulative_trapezoid(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str, *, chunk: int | None = DEFAULT_CHUNK_NS) -> DataFrame:
    """Running trapezoidal integral over time, zero at the first sample."""
    t = order[0]
    part = ordered.stencil(
        df,
        keys,
        order,
        lambda w: {"__area": F.coalesce((F.col(value) + F.lag(value).over(w)) * seconds(F.col(t) - F.lag(t).over(w)) / 2, F.lit(0.0))},
        ahead=0,
        chunk=chunk,
    )
    return ordered.running(part, keys, order, chunk=chunk, sums={out: F.col("__area")}).drop("__area")


def displacement_from_first(df: DataFrame, keys: Sequence[str], order: Sequence[str], axes: Sequence[str], out: str, valid: Column | None = None) -> DataFrame:
    """Distance of each valid sample from the first valid sample of its series."""
    ok = F.lit(True) if valid is None else F.coalesce(valid, F.lit(False))
    for axis in axes:
        ok = ok & F.col(axis).isNotNull()
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*axes), F.when(ok, F.struct(*order))).alias("__first"))
    total = F.lit(0.0)
    for axis in axes:
        delta = F.col(axis) - F.col(f"__first.{axis}")
        total = total + delta * delta
    return ordered.attach(df, first, keys, order[0]).withColumn(out, F.when(ok, F.sqrt(total))).drop("__first")


def local_plane(df: DataFrame, keys: Sequence[str], order: Sequence[str], latitude: str, longitude: str, *, radius: float = SPHERE_RADIUS_M) -> DataFrame:
    """East and north metres from the first sample of each series."""
    origin = df.groupBy(*keys).agg(F.min_by(F.struct(F.col(latitude).alias("lat"), F.col(longitude).alias("lon")), F.struct(*order)).alias("__origin"))
    lat0, lon0 = F.radians("__origin.lat"), F.radians("__origin.lon")
    return (
        ordered.attach(df, origin, keys, order[0])
        .withColumns(
            {
                "east_m": F.lit(radius) * (F.radians(longitude) - lon0) * F.cos(lat0),
                "north_m": F.lit(radius) * (F.radians(latitude) - lat0),
            }
        )
        .drop("__origin")
    )


def uniform_step(df: DataFrame, keys: Sequence[str], order: Sequence[str], *, tolerance_ns: int = 1, chunk: int | None = DEFAULT_CHUNK_NS) -> DataFrame:
    """One row per series: its first step and whether every step agrees with it."""
    t = order[0]
    stepped = ordered.stencil(df, keys, order, lambda w: {"__step": F.col(t) - F.lag(t).over(w)}, ahead=0, chunk=chunk)
    out = stepped.groupBy(*keys).agg(
        F.min_by("__step", F.when(F.col("__step").isNotNull(), F.struct(*order))).alias("step_ns"),
        F.min("__step").alias("__low"),
        F.max("__step").alias("__high"),
        F.count(F.lit(1)).alias("samples"),
    )
    steady = (F.col("__low") > 0) & (F.greatest(F.col("__high") - F.col("step_ns"), F.col("step_ns") - F.col("__low")) <= tolerance_ns)
    return out.withColumn("is_uniform", F.coalesce(steady, F.lit(False))).drop("__low", "__high")


def nominal_rate(df: DataFrame, keys: Sequence[str], order: Sequence[str], declared: str | None = None, *, chunk: int | None = DEFAULT_CHUNK_NS) -> DataFrame:
    """Declared rate, else one over the median step; several declared rates give NULL and a flag."""
    t = order[0]
    stepped = ordered.stencil(df, keys, order, lambda w: {"__step": F.col(t) - F.lag(t).over(w)}, ahead=0, chunk=chunk)
    rate = F.col(declared) if declared else F.lit(None).cast("double")
    positive = F.when(rate > 0, rate)
    # Steps repeat, so count equal steps first: the exact median then needs one row per distinct step.
    counted = stepped.groupBy(*keys, "__step").agg(F.count(F.lit(1)).alias("__n"), F.min(positive).alias("__low"), F.max(positive).alias("__high"))
    out = counted.groupBy(*keys).agg(F.min("__low").alias("__low"), F.max("__high").alias("__high"), F.percentile("__step", F.lit(0.5), F.col("__n")).alias("__median"))
    derived = F.when(F.col("__median") > 0, F.lit(1e9) / F.col("__median"))
    several = F.coalesce(F.col("__low") < F.col("__high"), F.lit(False))
    return out.select(*keys, several.alias("is_ambiguous"), F.when(~several, F.coalesce("__high", derived)).alias("rate_hz"))


# -- locomotor processor --------------------------------------------------------


def locomotor_series(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    x: str,
    y: str,
    *,
    method: str = "planar",
    radius: float = SPHERE_RADIUS_M,
    detected: str | None = None,
    max_step_speed: float | None = None,
    drop_gated_distance: bool = False,
    edge: str = OPEN_EDGE,
    chunk: int | None = DEFAULT_CHUNK_NS,
) -> DataFrame:
    """Speed, velocity and acceleration per sample, with the two quality gates.

    A step faster than ``max_step_speed`` invalidates both of its ends; invalid
    samples and their neighbours claim no velocity.  With ``method='haversine'``
    x/y are latitude/longitude and velocities come from the local plane.
    """
    t = order[0]
    kx, ky = x, y
    if method == "haversine":
        df = local_plane(df, keys, order, x, y, radius=radius)
        kx, ky = "east_m", "north_m"

    def steps(w: WindowSpec) -> Mapping[str, Column]:
        return {"step_m": step_length(w, x, y, method, radius), "duration_s": sample_duration(w, t), "__dt": seconds(F.col(t) - F.lag(t).over(w))}

    def gates(w: WindowSpec) -> Mapping[str, Column]:
        fast = F.lit(False)
        if max_step_speed is not None:
            fast = F.coalesce(F.col("step_m") / F.col("__dt") > max_step_speed, F.lit(False))
        bad = fast | F.coalesce(F.lead(fast).over(w), F.lit(False)) if max_step_speed is not None else F.lit(False)
        if detected is not None:
            bad = bad | ~F.coalesce(F.col(detected), F.lit(False))
        return {"step_gated": fast, "sample_invalid": bad}

    def velocity(w: WindowSpec) -> Mapping[str, Column]:
        dim = spread(w, F.col("sample_invalid"))
        return {
            "vx_m_s": F.when(~dim, central_difference(w, kx, t, edge)),
            "vy_m_s": F.when(~dim, central_difference(w, ky, t, edge)),
        }

    def acceleration(w: WindowSpec) -> Mapping[str, Column]:
        return {
            "ax_m_s2": central_difference(w, "vx_m_s", t, edge),
            "ay_m_s2": central_difference(w, "vy_m_s", t, edge),
            "tangential_m_s2": central_difference(w, F.hypot("vx_m_s", "vy_m_s"), t, edge),
            "speed_m_s": F.hypot("vx_m_s", "vy_m_s"),
        }

    out = ordered.stencil(df, keys, order, steps, gates, velocity, acceleration, back=3, ahead=3, chunk=chunk).drop("__dt")
    if drop_gated_distance:
        out = out.withColumn("step_m", F.when(F.col("step_gated"), 0.0).otherwise(F.col("step_m")))
    return out


def locomotor_summary(series: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """Totals and peaks per series; one shuffle with partial aggregation."""
    out = series.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("samples"),
        F.sum("step_m").alias("distance_total_m"),
        seconds(F.max(time) - F.min(time)).alias("duration_s"),
        F.max("speed_m_s").alias("max_speed_m_s"),
        F.max(F.hypot("ax_m_s2", "ay_m_s2")).alias("__accel"),
        F.min("tangential_m_s2").alias("__slowest"),
        F.count_if("sample_invalid").alias("invalid_samples"),
        F.count_if("step_gated").alias("excluded_steps"),
    )
    return out.select(
        *keys,
        "samples",
        "distance_total_m",
        "duration_s",
        F.when(F.col("duration_s") > 0, F.col("distance_total_m") / F.col("duration_s")).otherwise(0.0).alias("mean_speed_m_s"),
        "max_speed_m_s",
        F.coalesce("__accel", F.lit(0.0)).alias("max_acceleration_m_s2"),
        F.greatest(F.lit(0.0), -F.coalesce("__slowest", F.lit(0.0))).alias("max_deceleration_m_s2"),
        "invalid_samples",
        "excluded_steps",
    )


def zone_stats(series: DataFrame, keys: Sequence[str], zones: Sequence[tuple[str, float, float | None]]) -> DataFrame:
    """Distance, time, peak and samples per half-open speed zone, one row per series and zone."""
    speed = F.col("speed_m_s")
    totals = []
    for name, low, high in zones:
        inside = speed >= low if high is None else (speed >= low) & (speed < high)
        totals.append(
            F.struct(
                F.lit(name).alias("zone"),
                F.coalesce(F.sum(F.when(inside, F.col("step_m"))), F.lit(0.0)).alias("distance_m"),
                F.coalesce(F.sum(F.when(inside, F.col("duration_s"))), F.lit(0.0)).alias("duration_s"),
                F.coalesce(F.max(F.when(inside, speed)), F.lit(0.0)).alias("peak_speed_m_s"),
                F.count_if(inside).alias("samples"),
            )
        )
    return series.groupBy(*keys).agg(F.array(*totals).alias("__zones")).select(*keys, F.inline("__zones"))


def effort_segments(
    series: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    threshold: float,
    min_duration_s: float,
    merge_gap_s: float = 0.0,
    hysteresis: float = 0.0,
    sample_index: str = "sample_index",
    chunk: int | None = DEFAULT_CHUNK_NS,
) -> DataFrame:
    """Efforts entered at the threshold and left below threshold minus hysteresis.

    A missing speed ends an effort.  The state is the last decisive sample, and
    the number of leaving samples so far names the run, so one pass of carried
    values finds all runs.  Merged efforts include the samples of the gap between
    them, through running totals read at both ends.
    """
    t = order[0]
    speed = F.col("speed_m_s")
    release = max(0.0, threshold - hysteresis)
    # Both passes below read the narrow written series instead of deriving it twice.
    series = settle(series.select(*keys, *order, *([sample_index] if sample_index not in order else []), "speed_m_s", "duration_s", "step_m"))
    decisive = F.when(speed.isNull(), 0).when(speed >= threshold, 1).when(speed < release, 0)
    state = ordered.running(
        series,
        keys,
        order,
        chunk=chunk,
        lasts={"__state": decisive},
        sums={
            "__run": F.when(decisive == 0, 1).otherwise(0).cast("bigint"),
            "__time": F.col("duration_s"),
            "__dist": F.col("step_m"),
        },
    )
    place = F.struct(*order)
    runs = (
        state.filter(F.col("__state") == 1)
        .groupBy(*keys, "__run")
        .agg(
            F.min(t).alias("begin_ns"),
            F.max(t).alias("end_ns"),
            F.min_by(F.struct(F.col(sample_index).alias("i"), (F.col("__time") - F.col("duration_s")).alias("time"), (F.col("__dist") - F.col("step_m")).alias("dist")), place).alias("__b"),
            F.max_by(F.struct(F.col(sample_index).alias("i"), F.col("__time").alias("time"), F.col("__dist").alias("dist")), place).alias("__e"),
            F.max("speed_m_s").alias("peak"),
        )
    )
    runs = settle(runs)
    gap = int(round(merge_gap_s * 1e9))
    runs = ordered.stencil(
        runs, keys, ["begin_ns"], lambda w: {"__new": F.coalesce(F.col("begin_ns") - F.lag("end_ns").over(w) > gap, F.lit(True))}, ahead=0, chunk=chunk
    )
    runs = ordered.islands(runs, keys, ["begin_ns"], F.col("__new"), "__effort", chunk=chunk)
    merged = runs.groupBy(*keys, "__effort").agg(
        F.min_by("__b", "begin_ns").alias("__begin"), F.max_by("__e", "begin_ns").alias("__end"), F.min("begin_ns").alias("start_ns"), F.max("end_ns").alias("end_ns"), F.max("peak").alias("peak_speed_m_s")
    )
    kept = merged.withColumns({"duration_s": F.col("__end.time") - F.col("__begin.time"), "distance_m": F.col("__end.dist") - F.col("__begin.dist")}).filter(
        F.col("duration_s") + 1e-9 >= min_duration_s
    )
    kept = ordered.number(kept, keys, ["start_ns"], "effort_index", chunk=chunk)
    return kept.select(
        *keys,
        "effort_index",
        F.col("__begin.i").alias("start_sample_index"),
        F.col("__end.i").alias("end_sample_index"),
        "start_ns",
        "end_ns",
        "duration_s",
        "distance_m",
        "peak_speed_m_s",
        F.when(F.col("duration_s") > 0, F.col("distance_m") / F.col("duration_s")).otherwise(0.0).alias("mean_speed_m_s"),
    )


def effort_totals(efforts: DataFrame, keys: Sequence[str]) -> DataFrame:
    return efforts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("effort_count"),
        F.sum("duration_s").alias("effort_duration_total_s"),
        F.sum("distance_m").alias("effort_distance_total_m"),
        F.max("peak_speed_m_s").alias("effort_peak_speed_m_s"),
    )


def rolling_peak(
    series: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    windows_s: Sequence[float],
    *,
    step: str = "step_m",
    sample_index: str = "sample_index",
    chunk: int | None = DEFAULT_CHUNK_NS,
) -> DataFrame:
    """Largest distance inside any full window; the earliest window wins a tie.

    Distances inside a window are differences of a running sum that may start
    anywhere, so each chunk (plus one window of earlier rows) sums on its own.
    Sums are exact decimals (15 digits after the point, steps below 1e13 m): as
    doubles, equal windows in different chunks would differ by rounding.
    """
    t = order[0]
    exact = F.when(is_finite(step), F.col(step)).cast("decimal(28,15)").alias(step)
    narrow = settle(series.select(*keys, *order, exact, *([sample_index] if sample_index not in order else [])))
    begins = narrow.groupBy(*keys).agg(F.min(t).alias("__t0"))
    out = None
    for window_s in windows_s:
        span = int(round(window_s * 1e9))

        def covered(ranged: WindowSpec, along: WindowSpec) -> Mapping[str, Column]:
            return {"__cum": F.sum(step).over(along.rowsBetween(Window.unboundedPreceding, 0))}

        def inside(ranged: WindowSpec, along: WindowSpec) -> Mapping[str, Column]:
            return {"__covered": F.col("__cum") - F.min("__cum").over(ranged)}

        moved = ordered.trailing(narrow, keys, t, covered, inside, span=span, chunk=chunk, tie=order[1:])
        full = ordered.attach(moved, begins, keys, t).filter((F.col(t) - F.col("__t0") >= span) & (F.col(t) > F.col("__t0")))
        best = full.groupBy(*keys).agg(
            F.max_by(F.struct(F.col("__covered").cast("double").alias("d"), F.col(sample_index).alias("i"), F.col(t).alias("t")), F.struct(F.col("__covered"), -F.col(t))).alias("__best")
        )
        rows = best.select(
            *keys,
            F.lit(float(window_s)).alias("window_s"),
            F.col("__best.d").alias("peak_distance_m"),
            (F.col("__best.d") / float(window_s)).alias("peak_mean_speed_m_s"),
            F.col("__best.i").alias("end_sample_index"),
            F.col("__best.t").alias("end_ns"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out
