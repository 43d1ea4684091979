"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Standard gravity and the mean sphere radius used for geodesy.
GRAVITY_M_S2 = 9.80665
SPHERE_RADIUS_M = 6_371_008.8


def col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def finite(value: str | Column) -> Column:
    """NULL for NaN and infinities, so missing is always NULL downstream."""
    c = col(value)
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def is_finite(value: str | Column) -> Column:
    c = col(value)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def seconds(nanoseconds: str | Column) -> Column:
    return col(nanoseconds) / F.lit(1e9)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, NULL where the denominator is not positive."""
    return F.when(denominator > 0, numerator / denominator)


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = SPHERE_RADIUS_M) -> Column:
    a1, a2 = F.radians(lat1), F.radians(lat2)
    half_lat, half_lon = F.sin((a2 - a1) / 2), F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    chord = half_lat * half_lat + F.cos(a1) * F.cos(a2) * half_lon * half_lon
    return F.lit(2.0 * radius) * F.asin(F.least(F.lit(1.0), F.sqrt(chord)))


def arrival_time_s(px, py, vx, vy, tx, ty, *, reaction: float, top_speed: float, top_accel: float) -> Column:
    """Time to reach (tx, ty): coast for the reaction time, then accelerate to a speed cap."""
    px, py, vx, vy, tx, ty = map(col, (px, py, vx, vy, tx, ty))
    raw = F.hypot(vx, vy)
    shrink = F.when(raw > top_speed, F.lit(top_speed) / raw).otherwise(F.lit(1.0))
    speed = F.least(raw, F.lit(top_speed))
    gap = F.hypot(tx - (px + vx * shrink * reaction), ty - (py + vy * shrink * reaction))
    entry = F.least(F.lit(top_speed), speed + top_accel * reaction)
    if top_accel <= 0:
        run = gap / max(top_speed, 1e-12)
    else:
        ramp = F.greatest(F.lit(0.0), (F.lit(top_speed * top_speed) - entry * entry) / (2.0 * top_accel))
        inside = (F.sqrt(entry * entry + 2.0 * top_accel * gap) - entry) / top_accel
        beyond = (F.lit(top_speed) - entry) / top_accel + (gap - ramp) / top_speed
        run = F.when(gap <= ramp, inside).otherwise(beyond)
    return F.lit(reaction) + F.when(gap <= 0, F.lit(0.0)).otherwise(run)
