"""Units, clocks, identities, payload checks and labels as column expressions."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pacelane.functions.scalar import col, is_finite
from pacelane.operators.ordered import attach

# Canonical unit and factor of each accepted linear unit, in the
# order of the quantity they measure.
UNIT_FACTORS: dict[str, tuple[str, float]] = {
    "m": ("m", 1.0), "km": ("m", 1000.0), "cm": ("m", 0.01), "mm": ("m", 0.001), "ft": ("m", 0.3048), "in": ("m", 0.0254), "yd": ("m", 0.9144),
    "s": ("s", 1.0), "ms": ("s", 0.001), "us": ("s", 1e-6), "ns": ("s", 1e-9), "min": ("s", 60.0), "h": ("s", 3600.0),
    "m/s": ("m/s", 1.0), "km/h": ("m/s", 1000.0 / 3600.0), "mph": ("m/s", 0.44704), "ft/s": ("m/s", 0.3048),
    "m/s**2": ("m/s**2", 1.0), "g_0": ("m/s**2", 9.80665),
    "m/s**3": ("m/s**3", 1.0),
    "rad": ("rad", 1.0), "deg": ("rad", 3.141592653589793 / 180.0), "rad/s": ("rad/s", 1.0), "deg/s": ("rad/s", 3.141592653589793 / 180.0),
    "N": ("N", 1.0), "kN": ("N", 1000.0), "N*m": ("N*m", 1.0),
    "W": ("W", 1.0), "kW": ("W", 1000.0), "W/kg": ("W/kg", 1.0),
    "kg": ("kg", 1.0), "g": ("kg", 0.001), "lb": ("kg", 0.45359237),
    "Hz": ("Hz", 1.0), "kHz": ("Hz", 1000.0),
    "T": ("T", 1.0), "uT": ("T", 1e-6),
    "1": ("1", 1.0), "%": ("1", 0.01),
}
# Offset units as (canonical, factor, shift in kelvin).
OFFSET_UNITS: dict[str, tuple[str, float, float]] = {"K": ("K", 1.0, 0.0), "degC": ("K", 1.0, 273.15), "degF": ("K", 5.0 / 9.0, 459.67 * 5.0 / 9.0)}


def _map(values: Mapping[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def convert_units(value: str | Column, unit: str | Column, target: str) -> Column:
    """Value in ``target``; NULL when the unit is unknown or measures something else."""
    value, unit = col(value), col(unit)
    if target in OFFSET_UNITS:
        _, factor, shift = OFFSET_UNITS[target]
        factors, shifts = _map({u: v[1] for u, v in OFFSET_UNITS.items()}), _map({u: v[2] for u, v in OFFSET_UNITS.items()})
        kelvin = value * F.try_element_at(factors, unit) + F.try_element_at(shifts, unit)
        return (kelvin - shift) / factor
    base, factor = UNIT_FACTORS[target]
    same = {u: f for u, (b, f) in UNIT_FACTORS.items() if b == base}
    return value * F.try_element_at(_map(same), unit) / factor


def match_clock_ns(text: str | Column) -> Column:
    """``HH:MM:SS.cc`` to ns; NULL for any other shape or an out-of-range part."""
    text = F.trim(col(text))
    part = lambda i: F.regexp_extract(text, r"^([0-9]+):([0-9]+):([0-9]+)\.([0-9]{2})$", i).cast("bigint")
    good = text.rlike(r"^[0-9]+:0*[0-5]?[0-9]:0*[0-5]?[0-9]\.[0-9]{2}$")
    return F.when(good, ((part(1) * 60 + part(2)) * 60 + part(3)) * 1_000_000_000 + part(4) * 10_000_000)


def relative_ns(df: DataFrame, keys: Sequence[str], micros: str, out: str = "t_rel_ns") -> DataFrame:
    """Nanoseconds since each key's earliest time; the origin comes from an aggregate, not a window."""
    origin = df.groupBy(*keys).agg(F.min(micros).alias("__origin"))
    return attach(df, origin, keys, micros).withColumn(out, (F.col(micros) - F.col("__origin")) * 1000).drop("__origin")


def map_clock(value: Column, *, scale_to_ns: str, period_origin_ns: Column, counts_down_from: Column | None = None, offset_ns: int = 0) -> Column:
    """Affine clock map in decimal arithmetic, rounded half to even."""
    source = value.cast("decimal(28,9)")
    elapsed = source if counts_down_from is None else counts_down_from.cast("decimal(28,9)") - source
    return period_origin_ns + F.lit(offset_ns) + F.bround(elapsed * F.lit(scale_to_ns).cast("decimal(20,9)"), 0).cast("bigint")


def apply_alignment(t_ns: str | Column, scale: float | Column, offset_ns: int | Column) -> Column:
    """Declared affine time alignment, rounded half to even."""
    scale = scale if isinstance(scale, Column) else F.lit(scale)
    offset = offset_ns if isinstance(offset_ns, Column) else F.lit(offset_ns)
    return F.rint(col(t_ns) * scale + offset).cast("bigint")


def rigid_transform(point: Sequence[str], quaternion: Sequence[Column], translation: Sequence[Column]) -> tuple[Column, Column, Column]:
    """Rotate by a unit quaternion (x, y, z, w), then translate.

    Written as p + 2w(q x p) + 2 q x (q x p), which needs no matrix.
    """
    p, (qx, qy, qz, qw) = [F.col(c) for c in point], quaternion
    cross = lambda u, v: (u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])
    once = cross((qx, qy, qz), p)
    twice = cross((qx, qy, qz), once)
    return tuple(p[i] + 2 * qw * once[i] + 2 * twice[i] + translation[i] for i in range(3))


def canonical_id(namespace: str | Column, kind: str | Column, provider_id: Column) -> Column:
    """Stable key of a provider entity: kind and 24 hex digits of an MD5."""
    namespace, kind = (F.lit(v) if isinstance(v, str) else v for v in (namespace, kind))
    return F.concat(kind, F.lit("-"), F.substring(F.md5(F.concat_ws(":", namespace, kind, provider_id.cast("string"))), 1, 24))


def crosswalk_id(namespace: str, kind: str, provider_id: Column) -> Column:
    return F.concat(F.lit("xw-"), F.md5(F.concat_ws(":", F.lit(namespace), F.lit(kind), provider_id.cast("string"))))


def sorted_json(fields: Mapping[str, Column]) -> Column:
    """Compact JSON with sorted keys; missing values stay as null."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def metric_row_id(fields: Mapping[str, Column]) -> Column:
    return F.concat(F.lit("dm-"), F.substring(F.sha2(sorted_json(fields), 256), 1, 32))


def run_id(fields: Mapping[str, Column], checksums: Column) -> Column:
    return F.concat(F.lit("run-"), F.substring(F.sha2(sorted_json({**fields, "input_checksums": F.array_sort(checksums)}), 256), 1, 16))


def parameters_hash(parameters: Mapping[str, object]) -> str:
    """Hash of a parameter mapping; values that JSON cannot hold exactly raise."""
    import hashlib

    text = json.dumps(dict(parameters), sort_keys=True, separators=(",", ":"), allow_nan=False)
    return hashlib.sha256(text.encode()).hexdigest()


# Suffixes of provider columns that only serve presentation.
PRESENTATION_SUFFIXES = ("_logo", "_color", "_alternate_color", "_href", "_uid", "_slug")


def preserve_source(df: DataFrame, prefix: str = "src_") -> DataFrame:
    return df.withColumnsRenamed({c: f"{prefix}{c}" for c in df.columns})


def unprefix_source(df: DataFrame, prefix: str = "src_") -> DataFrame:
    """Drop presentation columns and mark provider columns as ``source__``."""
    keep = [c for c in df.columns if not (c.startswith(prefix) and c.endswith(PRESENTATION_SUFFIXES))]
    return df.select(*[F.col(c).alias(f"source__{c[len(prefix):]}") if c.startswith(prefix) else F.col(c) for c in keep])


def event_attributes(names: Sequence[str]) -> Column:
    """Named provider columns as canonical JSON; NaN becomes null."""
    return sorted_json({n: F.col(n) for n in names})


def iso_text(name: str) -> Column:
    """ISO text of a timestamp, with a fraction only if there is one."""
    whole = F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(name, ".SSSSSS")
    return F.concat(whole, F.when(fraction == ".000000", "").otherwise(fraction))


def clean_doubles(df: DataFrame) -> DataFrame:
    """NULL for every non-finite double, ISO text for dates and timestamps."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind in ("double", "float"):
            c = F.when(is_finite(name), c)
        elif kind == "date":
            c = F.date_format(c, "yyyy-MM-dd")
        elif kind.startswith("timestamp"):
            c = iso_text(name)
        out.append(c.alias(name))
    return df.select(*out)


# JSON type names of an attribute schema and the variant types they admit.
ATTRIBUTE_TYPES = {
    "string": "^STRING$", "number": "^(BIGINT|DOUBLE|DECIMAL.*)$", "integer": "^BIGINT$", "boolean": "^BOOLEAN$", "object": "^OBJECT.*$", "array": "^ARRAY.*$", "null": "^VOID$",
}


def check_attributes(payload: str, properties: Mapping[str, str], required: Sequence[str] = (), additional: bool = False) -> dict[str, Column]:
    """Missing, unknown and wrongly typed attributes of a JSON payload, as arrays of names."""
    value = F.try_parse_json(payload)
    keys = F.json_object_keys(payload)
    kinds = {name: F.schema_of_variant(F.try_variant_get(value, f"$.{name}", "variant")) for name in properties}
    wrong = F.filter(
        F.array(*[F.when(F.array_contains(keys, name) & ~F.coalesce(kinds[name].rlike(ATTRIBUTE_TYPES[kind]), F.lit(False)), F.lit(name)) for name, kind in properties.items()]),
        lambda n: n.isNotNull(),
    )
    known = F.array(*[F.lit(n) for n in properties])
    unknown = F.array().cast("array<string>") if additional else F.array_sort(F.array_except(keys, known))
    needed = F.array(*[F.lit(n) for n in required]).cast("array<string>")
    return {"missing": F.array_sort(F.array_except(needed, keys)), "unknown": unknown, "wrong_type": F.array_sort(wrong)}


def first_present(payload: str, *names: str) -> Column:
    """First non-null of several candidate keys of a JSON record."""
    return F.coalesce(*[F.get_json_object(payload, f"$.{n}") for n in names])


def event_location(payload: str, names: Sequence[str] = ("location", "loc", "startLoc", "startLocation")) -> Column:
    """Point of an event record, which may be {x,y,z}, {xyz:[..]} or [x,y,z], with the field it came from."""
    options = []
    for name in names:
        at = lambda path: F.get_json_object(payload, f"$.{name}{path}")  # noqa: E731, B023
        for paths in ((".xyz[0]", ".xyz[1]", ".xyz[2]"), (".x", ".y", ".z"), ("[0]", "[1]", "[2]")):
            x, y, z = (at(p).try_cast("double") for p in paths)
            options.append(F.when(is_finite(x) & is_finite(y), F.struct(x.alias("x"), y.alias("y"), F.when(is_finite(z), z).alias("z"), F.lit(name).alias("field"))))
    return F.coalesce(*options)


def finite_split(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Adds ``rule``: why a row is set aside, NULL for a good row."""
    missing, bad = F.lit(False), F.lit(False)
    for c in columns:
        missing = missing | F.col(c).isNull()
        bad = bad | ~F.coalesce(is_finite(c), F.lit(True))
    return df.withColumn("rule", F.when(missing, "coordinate_missing").when(bad, "non_finite_value"))


# Source position codes and groups with their role.
POSITION_ROLES = {
    "TW": "GK", "LV": "DEF", "RV": "DEF", "IVL": "DEF", "IVR": "DEF", "DML": "MID", "DMR": "MID", "DMZ": "MID", "OLM": "MID", "ORM": "MID", "ZO": "MID", "STL": "ATT", "STR": "ATT", "STZ": "ATT",
}
GROUP_ROLES = {"Goalkeeper": "GK", "Central Defender": "DEF", "Full Back": "DEF", "Midfield": "MID", "Center Forward": "ATT", "Wide Attacker": "ATT"}
ACRONYM_ROLES = {"GK": "GK"}


def role_domain(group: Column, acronym: Column | None = None, roles: Mapping[str, str] = GROUP_ROLES) -> Column:
    """Role of a source position; an acronym override beats the group, anything else is unknown."""
    by_group = F.try_element_at(_map(roles), F.trim(F.coalesce(group, F.lit(""))))
    by_acronym = F.lit(None) if acronym is None else F.try_element_at(_map(ACRONYM_ROLES), F.upper(F.coalesce(acronym, F.lit(""))))
    return F.coalesce(by_acronym, by_group, F.lit("unknown"))


def dead_time(players: Column, ball_present: Column) -> Column:
    return (players == 0) & ~ball_present


def snake_case(text: str | Column) -> Column:
    """An underscore before each capital that follows a non-capital, then lower case."""
    return F.lower(F.regexp_replace(col(text), r"(?<=[^\p{Lu}])(\p{Lu})", "_$1"))


def metric_token(text: str | Column, keep_case: bool = False) -> Column:
    """Runs of other characters become one underscore; NULL when nothing is left."""
    text = F.trim(col(text)) if keep_case else F.lower(F.trim(col(text)))
    pattern = "[^A-Za-z0-9]+" if keep_case else "[^a-z0-9]+"
    token = F.regexp_replace(F.regexp_replace(text, pattern, "_"), "^_+|_+$", "")
    return F.when(token != "", token)


def token_collisions(df: DataFrame, name: str) -> DataFrame:
    """Tokens that several different names fold into."""
    return df.select(F.col(name).alias("name"), metric_token(name).alias("token")).distinct().groupBy("token").agg(F.count(F.lit(1)).alias("names")).filter("names > 1")


def numeric_with_unit(text: str | Column, unit: str) -> Column:
    """Number of a text like ``20kg``; NULL for anything else."""
    return F.regexp_extract(F.lower(F.trim(col(text))), rf"^([0-9]+(?:\.[0-9]+)?)\s*{unit}$", 1).try_cast("double")


def iso_ns(text: str | Column) -> Column:
    """ISO-8601 instant with a zone to ns; NULL without a zone or when unreadable."""
    text = col(text)
    zoned = text.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$")
    return F.when(zoned, F.unix_micros(F.try_to_timestamp(text)) * 1000)


def play_category(sport: Column, event_type: Column) -> Column:
    """Presentation class of a play; a sport without a vocabulary shows the provider type."""
    return F.when(sport.isin("nba", "nhl"), F.lower(F.regexp_replace(event_type, "[^A-Za-z0-9]+", "_"))).otherwise(event_type)


def range_position(value: Column, low: Column, high: Column) -> Column:
    """Place of a value in [low, high] as 0..1; one half when the range is flat."""
    inside = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (value - low) / F.when(high != low, high - low)))
    return F.when(value.isNull() | low.isNull() | high.isNull(), None).when(high == low, 0.5).otherwise(inside)
