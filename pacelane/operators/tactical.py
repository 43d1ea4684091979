"""Team shape, spacing, territory and influence per tracking frame.

A frame is (stream, time).  Rows are first reduced to one per object; after that a
frame is as long as a line-up and is packed into arrays, so questions about pairs
of players are answered inside the row instead of by joining a frame to itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pacelane.functions import planar
from pacelane.functions.scalar import is_finite, seconds
from pacelane.operators import ordered
from pacelane.operators.grouped import spread
from pacelane.operators import segments as seg
from pacelane.session import settle

DEFAULT_CHUNK_NS = 600_000_000_000
FRAME = ["stream_id", "t_rel_ns"]
PLAYER_TYPES = ("player", "goalkeeper")
RIGHT_TO_LEFT = "right_to_left"
ROUNDING = 1e-12
"""Error of a covariance of a line-up, as a share of its variances."""


def is_player() -> Column:
    return F.coalesce(F.col("object_type").isin(*PLAYER_TYPES) & F.col("group_id").isNotNull() & F.col("object_id").isNotNull(), F.lit(False))


def outside_pitch(x: str, y: str, length: float, width: float) -> Column:
    return ~(F.col(x).between(-length / 2, length / 2) & F.col(y).between(-width / 2, width / 2))


def players(df: DataFrame, keys: Sequence[str] = FRAME, order: str = "sample_index", fields: Sequence[str] = ("object_type", "role", "is_detected")) -> DataFrame:
    """One row per object and frame: the first usable one in source order."""
    good = df.filter(is_player() & is_finite("x_m") & is_finite("y_m"))
    rest = F.struct("x_m", "y_m", *fields)
    return good.groupBy(*keys, "group_id", "object_id").agg(F.min_by(rest, order).alias("__p")).select(*keys, "group_id", "object_id", "__p.*")


def ball(df: DataFrame, keys: Sequence[str] = FRAME, order: str = "sample_index") -> DataFrame:
    """One ball position per frame: the first usable one in source order."""
    good = df.filter((F.col("object_type") == "ball") & is_finite("x_m") & is_finite("y_m"))
    return good.groupBy(*keys).agg(F.min_by(F.struct(F.col("x_m").alias("x"), F.col("y_m").alias("y")), F.struct(order, "x_m", "y_m")).alias("ball"))


def frame_quality(df: DataFrame, keys: Sequence[str] = FRAME, *, length: float = 105.0, width: float = 68.0) -> DataFrame:
    """Missing, outside, extrapolated and duplicate rows per frame that has players."""
    known = F.coalesce(is_finite("x_m") & is_finite("y_m"), F.lit(False))
    flags = df.withColumns(
        {
            "__known": known,
            "__outside": known & outside_pitch("x_m", "y_m", length, width),
            "__guess": known & F.coalesce(~F.col("is_detected"), F.lit(False)),
            "__player": known & is_player(),
        }
    )
    per_object = flags.groupBy(*keys, "group_id", "object_id").agg(
        F.count_if(~F.col("__known")).alias("m"), F.count_if("__outside").alias("o"), F.count_if("__guess").alias("e"), F.count_if("__player").alias("p")
    )
    return (
        per_object.groupBy(*keys)
        .agg(
            F.sum("m").alias("missing_rows"),
            F.sum("o").alias("outside_rows"),
            F.sum("e").alias("extrapolated_rows"),
            F.sum(F.greatest(F.col("p") - 1, F.lit(0).cast("bigint"))).alias("duplicate_rows"),
            F.sum("p").alias("__players"),
        )
        .filter("__players > 0")
        .drop("__players")
    )


def pack(rows: DataFrame, keys: Sequence[str] = FRAME, fields: Sequence[str] = ("object_id", "group_id", "x_m", "y_m", "role")) -> DataFrame:
    """One row per frame with its players as an array, ordered by the first field."""
    return spread(rows, *keys).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("players"))


def _hypot(a: Column, b: Column) -> Column:
    return F.hypot(a["x_m"] - b["x_m"], a["y_m"] - b["y_m"])


def team_geometry(
    rows: DataFrame, balls: DataFrame | None = None, keys: Sequence[str] = FRAME, *, length: float = 105.0, width: float = 68.0, min_players: int = 2
) -> DataFrame:
    """Centroid, extent, hull, stretch and spacing of each team in each frame."""
    place = F.struct("object_id", "x_m", "y_m")
    teams = spread(rows, *keys).groupBy(*keys, "group_id").agg(
        F.count(F.lit(1)).alias("player_count"),
        F.avg("x_m").alias("centroid_x_m"),
        F.avg("y_m").alias("centroid_y_m"),
        (F.max("x_m") - F.min("x_m")).alias("__length"),
        (F.max("y_m") - F.min("y_m")).alias("__width"),
        F.sqrt(F.var_pop("x_m") + F.var_pop("y_m")).alias("__rms"),
        F.array_sort(F.collect_list(place)).alias("__at"),
    )
    pairs = F.flatten(F.transform("__at", lambda a, i: F.transform(F.slice(F.col("__at"), i + 2, F.size("__at")), lambda b: _hypot(a, b))))
    enough = F.col("player_count") >= min_players
    xs, ys = F.transform("__at", lambda p: p["x_m"]), F.transform("__at", lambda p: p["y_m"])
    out = teams.withColumns({"__pairs": pairs, "__hull": planar.hull_of(xs, ys)})
    some = enough & (F.size("__pairs") > 0)
    total = F.aggregate("__pairs", F.lit(0.0), lambda a, d: a + d)
    out = out.select(
        *keys,
        "group_id",
        "player_count",
        "centroid_x_m",
        "centroid_y_m",
        F.when(enough, F.col("__length")).alias("length_m"),
        F.when(enough, F.col("__width")).alias("width_m"),
        F.when(enough & (F.col("__width") > 0), F.col("__length") / F.col("__width")).alias("length_width_ratio"),
        F.when(enough, F.col("__hull.area")).alias("hull_area_m2"),
        F.when(enough, F.col("__rms") / F.lit((length**2 + width**2) ** 0.5)).alias("stretch_index"),
        F.when(some, total / F.size("__pairs")).alias("pairwise_distance_mean_m"),
        F.when(some, F.array_min("__pairs")).alias("pairwise_distance_min_m"),
        F.when(some, F.array_max("__pairs")).alias("pairwise_distance_max_m"),
        F.col("__hull.polygon").alias("hull_polygon"),
    )
    if balls is None:
        return out
    return (
        out.join(balls, list(keys), "left")
        .withColumn("ball_distance_to_centroid_m", F.hypot(F.col("centroid_x_m") - F.col("ball.x"), F.col("centroid_y_m") - F.col("ball.y")))
        .drop("ball")
    )


def nearest_neighbours(rows: DataFrame, keys: Sequence[str] = FRAME) -> DataFrame:
    """Per player: distance to the team centroid, nearest teammate and nearest opponent."""
    packed = pack(rows, keys, ("object_id", "group_id", "x_m", "y_m"))

    def facts(p: Column) -> Column:
        mates = F.filter("players", lambda o: o["group_id"] == p["group_id"])
        n = F.size(mates)
        mean = lambda axis: F.aggregate(mates, F.lit(0.0), lambda a, o: a + o[axis]) / n
        others = F.filter(mates, lambda o: o["object_id"] != p["object_id"])
        foes = F.filter("players", lambda o: o["group_id"] != p["group_id"])
        return F.struct(
            p["object_id"].alias("object_id"),
            p["group_id"].alias("group_id"),
            F.hypot(p["x_m"] - mean("x_m"), p["y_m"] - mean("y_m")).alias("distance_to_team_centroid_m"),
            F.array_min(F.transform(others, lambda o: _hypot(p, o))).alias("nearest_teammate_distance_m"),
            F.array_min(F.transform(foes, lambda o: _hypot(p, o))).alias("nearest_opponent_distance_m"),
        )

    return packed.select(*keys, F.inline(F.transform("players", facts)))


def team_relations(teams: DataFrame, keys: Sequence[str] = FRAME) -> DataFrame:
    """Per frame and pair of teams: distance of centroids and overlap of hulls."""
    item = F.struct("group_id", "centroid_x_m", "centroid_y_m", "hull_polygon")
    packed = teams.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("__teams"))
    pairs = F.flatten(F.transform("__teams", lambda a, i: F.transform(F.slice(F.col("__teams"), i + 2, F.size("__teams")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return packed.select(*keys, F.inline(pairs)).select(
        *keys,
        F.col("a.group_id").alias("group_a"),
        F.col("b.group_id").alias("group_b"),
        F.hypot(F.col("a.centroid_x_m") - F.col("b.centroid_x_m"), F.col("a.centroid_y_m") - F.col("b.centroid_y_m")).alias("inter_centroid_distance_m"),
        planar.overlap_area(F.col("a.hull_polygon"), F.col("b.hull_polygon")).alias("hull_overlap_area_m2"),
    )


def expansion_rate(teams: DataFrame, *, chunk: int | None = DEFAULT_CHUNK_NS) -> DataFrame:
    """Change of length and width per second since the team's previous frame, when both are valid."""

    def stage(w):
        dt = seconds(F.col("t_rel_ns") - F.lag("t_rel_ns").over(w))
        return {
            "expansion_rate_x_m_s": F.when(dt > 0, (F.col("length_m") - F.lag("length_m").over(w)) / dt),
            "expansion_rate_y_m_s": F.when(dt > 0, (F.col("width_m") - F.lag("width_m").over(w)) / dt),
        }

    return ordered.stencil(teams, ["stream_id", "group_id"], ["t_rel_ns"], stage, ahead=0, chunk=chunk)


# -- roles and shape ------------------------------------------------------------------


def sign_of(direction: Column) -> Column:
    return F.when(direction == RIGHT_TO_LEFT, -1.0).otherwise(1.0)


def zone(x: Column, y: Column, direction: Column, *, length: float = 105.0, width: float = 68.0) -> Column:
    """Third of the pitch of a point already turned to the attack; names differ without a direction."""
    inside = x.between(-length / 2, length / 2) & y.between(-width / 2, width / 2)
    low, high = x < -length / 6, x >= length / 6
    plain = F.when(low, "left_third").when(high, "right_third").otherwise("center_third")
    turned = F.when(low, "own_third").when(high, "opponent_third").otherwise("middle_third")
    return F.when(x.isNull() | y.isNull(), None).when(~inside, "out_of_bounds").when(direction.isNull(), plain).otherwise(turned)


def ball_zone(x: Column, y: Column, direction: Column, *, length: float = 105.0, width: float = 68.0) -> Column:
    """Zone of the ball; only the length axis turns with the direction of play."""
    return zone(x * sign_of(direction), y, direction, length=length, width=width)


def axis_angle(xx: Column, yy: Column, xy: Column) -> tuple[Column, Column, Column]:
    """Principal angle in degrees [0, 180) and the deviations along both axes.

    A covariance within the rounding error of its sums is zero: its sign depends on the order of the rows and would
    turn an angle of 0 into one of 180.
    """
    xy = F.when(F.abs(xy) > ROUNDING * (xx + yy), xy).otherwise(F.lit(0.0))
    root = F.sqrt(F.greatest(F.lit(0.0), (xx - yy) * (xx - yy) + 4 * xy * xy))
    major, minor = F.greatest(F.lit(0.0), (xx + yy + root) / 2), F.greatest(F.lit(0.0), (xx + yy - root) / 2)
    angle = F.when(root > 1e-12, F.pmod(F.degrees(F.atan2(2 * xy, xx - yy) / 2), F.lit(180.0)))
    return angle, F.sqrt(major), F.sqrt(minor)


def functional_units(rows: DataFrame, direction: Column | None = None, keys: Sequence[str] = FRAME) -> DataFrame:
    """Geometry of each role group of a team in attack coordinates."""
    turn = F.lit(1.0) if direction is None else sign_of(direction)
    rows = rows.withColumns({"__x": F.col("x_m") * turn, "__y": F.col("y_m") * turn})
    units = rows.groupBy(*keys, "group_id", F.col("role").alias("functional_unit")).agg(
        F.count(F.lit(1)).alias("player_count"),
        F.avg("__x").alias("centroid_x_m"),
        F.avg("__y").alias("centroid_y_m"),
        (F.max("__x") - F.min("__x")).alias("depth_x_m"),
        (F.max("__y") - F.min("__y")).alias("width_y_m"),
        F.var_pop("__x").alias("__xx"),
        F.var_pop("__y").alias("__yy"),
        F.covar_pop("__x", "__y").alias("__xy"),
    )
    angle, major, minor = axis_angle(F.col("__xx"), F.col("__yy"), F.col("__xy"))
    many = F.col("player_count") >= 2
    return units.withColumns(
        {
            "dispersion_rms_m": F.sqrt(F.col("__xx") + F.col("__yy")),
            "major_axis_sd_m": F.when(many, major).otherwise(0.0),
            "minor_axis_sd_m": F.when(many, minor).otherwise(0.0),
            "orientation_deg": F.when(many, angle),
        }
    ).drop("__xx", "__yy", "__xy")


def line_gaps(rows: DataFrame, direction: Column | None = None, keys: Sequence[str] = FRAME) -> DataFrame:
    """Distances between the lines of a team and the depth of its outfield block."""
    x = F.col("x_m") * (F.lit(1.0) if direction is None else sign_of(direction))
    line = lambda role: F.avg(F.when(F.col("role") == role, x))
    field = F.when(F.col("role").isin("DEF", "MID", "ATT"), x)
    return rows.groupBy(*keys, "group_id").agg(
        F.abs(line("DEF") - line("MID")).alias("def_mid_gap_m"),
        F.abs(line("MID") - line("ATT")).alias("mid_att_gap_m"),
        (F.max(field) - F.min(field)).alias("outfield_block_depth_m"),
    )


def attacker_defender(rows: DataFrame, keys: Sequence[str] = FRAME, *, radius: float = 10.0) -> DataFrame:
    """Per attacker: nearest two defenders, mutual-nearest tie-up and local numbers.

    Ties go to the smaller id.  An attacker is tied up when the nearest defender's
    own nearest attacker of that team is this attacker.
    """
    packed = pack(rows.filter(F.col("role").isin("ATT", "DEF")), keys)

    def facts(a: Column) -> Column:
        mates = F.filter("players", lambda p: (p["role"] == "ATT") & (p["group_id"] == a["group_id"]))
        foes = F.filter("players", lambda p: (p["role"] == "DEF") & (p["group_id"] != a["group_id"]))
        ranked = F.array_sort(F.transform(foes, lambda d: F.struct(_hypot(a, d).alias("m"), d["object_id"].alias("id"), d["x_m"].alias("x_m"), d["y_m"].alias("y_m"))))
        near, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
        answer = F.array_min(F.transform(mates, lambda t: F.struct(_hypot(t, near).alias("m"), t["object_id"].alias("id"))))
        count = lambda many: F.size(F.filter(many, lambda p: _hypot(a, p) <= radius))
        return F.struct(
            a["group_id"].alias("group_id"),
            a["object_id"].alias("attacker_id"),
            near["id"].alias("nearest_defender_id"),
            near["m"].alias("nearest_defender_distance_m"),
            second["id"].alias("second_nearest_defender_id"),
            second["m"].alias("second_nearest_defender_distance_m"),
            (answer["id"] == a["object_id"]).alias("geometric_tie_up"),
            count(mates).alias("local_attacker_count"),
            count(foes).alias("local_defender_count"),
        )

    attackers = F.filter("players", lambda p: p["role"] == "ATT")
    out = packed.select(*keys, F.inline(F.transform(attackers, facts))).filter("nearest_defender_id IS NOT NULL")
    return out.withColumns(
        {"geometric_free_attacker": ~F.col("geometric_tie_up"), "local_overload_margin_players": F.col("local_attacker_count") - F.col("local_defender_count")}
    )


def _distinct_spots(many: Column) -> Column:
    """Players of an id-ordered array, without those on the spot of a smaller id."""
    return F.filter(many, lambda p, i: ~F.exists(F.slice(many, F.lit(1), i), lambda o: (o["x_m"] == p["x_m"]) & (o["y_m"] == p["y_m"])))


def shape_triangles(rows: DataFrame, keys: Sequence[str] = FRAME) -> DataFrame:
    """Delaunay triangles of each team and frame as id triples with their corners."""
    packed = pack(rows, [*keys, "group_id"], ("object_id", "x_m", "y_m"))
    packed = packed.withColumn("__at", _distinct_spots(F.col("players")))
    found = packed.withColumn("__t", F.explode(planar.delaunay_of(F.transform("__at", lambda p: p["x_m"]), F.transform("__at", lambda p: p["y_m"]))))
    corner = lambda k: F.get("__at", F.col(f"__t.{k}"))
    return found.select(*keys, "group_id", *[corner(k).alias(k) for k in "abc"])


def shape_edges(triangles: DataFrame, keys: Sequence[str] = FRAME) -> DataFrame:
    """Distinct edges of the triangles, smaller id first."""
    id_of = lambda k: F.col(f"{k}.object_id")
    sides = F.array(*[F.struct(id_of(p).alias("player_a_id"), id_of(q).alias("player_b_id")) for p, q in ("ab", "ac", "bc")])
    return triangles.select(*keys, "group_id", F.inline(sides)).distinct()


def window_frames(rows: DataFrame, *, window_ns: int = 1_000_000_000, max_gap_ns: int = 200_000_000, chunk: int | None = DEFAULT_CHUNK_NS) -> DataFrame:
    """Per frame of a stream: its segment, how many frames its trailing window holds and how far back it reaches."""
    frames = rows.select(*FRAME).distinct()
    cut = settle(seg.segment_by_gap(frames, ["stream_id"], ["t_rel_ns"], max_gap_ns, "segment", chunk=chunk))
    return ordered.trailing(
        cut,
        ["stream_id", "segment"],
        "t_rel_ns",
        lambda ranged, along: {"window_frames": F.count(F.lit(1)).over(ranged), "coverage_ns": F.col("t_rel_ns") - F.min("t_rel_ns").over(ranged)},
        span=window_ns,
        chunk=chunk,
    )


def persistence(
    items: DataFrame,
    frames: DataFrame,
    identity: Sequence[str],
    *,
    window_ns: int = 1_000_000_000,
    min_fraction: float = 0.8,
    min_coverage_ns: int = 800_000_000,
    chunk: int | None = DEFAULT_CHUNK_NS,
) -> DataFrame:
    """Share of the trailing window's frames that hold each edge or triangle, and whether it is stable.

    ``frames`` (from ``window_frames``) counts frames without any item too.
    """
    placed = items.join(frames, FRAME)
    counted = ordered.trailing(
        placed, ["stream_id", "segment", *identity], "t_rel_ns", lambda ranged, along: {"__held": F.count(F.lit(1)).over(ranged)}, span=window_ns, chunk=chunk
    )
    fraction = F.col("__held") / F.col("window_frames")
    return counted.withColumns(
        {"persistence_fraction": fraction, "is_stable": (F.col("coverage_ns") >= min_coverage_ns) & (fraction >= min_fraction)}
    ).drop("__held", "segment", "coverage_ns")


def triangle_metrics(
    triangles: DataFrame, rows: DataFrame, balls: DataFrame, direction: Column | None = None, keys: Sequence[str] = FRAME, *, min_area: float = 1e-9, length: float = 105.0, width: float = 68.0
) -> DataFrame:
    """Area, aspect, angle, zone, opponents inside and nearest team of each triangle."""
    packed = pack(rows, keys, ("group_id", "object_id", "x_m", "y_m"))
    packed = packed.select(*keys, F.col("players.group_id").alias("__groups"), F.col("players.x_m").alias("__xs"), F.col("players.y_m").alias("__ys"))
    way = F.lit(None).cast("string") if direction is None else direction
    df = triangles.join(packed, list(keys)).join(balls, list(keys), "left").withColumns({"__way": way})
    df = df.withColumn("__turn", sign_of(F.col("__way")))
    corner = {k: (F.col(f"{k}.x_m") * F.col("__turn"), F.col(f"{k}.y_m") * F.col("__turn")) for k in "abc"}
    (ax, ay), (bx, by), (cx, cy) = corner["a"], corner["b"], corner["c"]
    df = df.withColumns(
        {
            "area_m2": F.abs((bx - ax) * (cy - ay) - (by - ay) * (cx - ax)) / 2,
            "__ab": F.hypot(bx - ax, by - ay),
            "__bc": F.hypot(cx - bx, cy - by),
            "__ca": F.hypot(ax - cx, ay - cy),
            "centroid_x_m": (ax + bx + cx) / 3,
            "centroid_y_m": (ay + by + cy) / 3,
        }
    ).filter(F.col("area_m2") > min_area)
    mx, my = F.col("centroid_x_m"), F.col("centroid_y_m")
    var = lambda p, q, r, m: ((p - m) * (p - m) + (q - m) * (q - m) + (r - m) * (r - m)) / 3
    xy = ((ax - mx) * (ay - my) + (bx - mx) * (by - my) + (cx - mx) * (cy - my)) / 3
    angle, _, _ = axis_angle(var(ax, bx, cx, mx), var(ay, by, cy, my), xy)

    df = df.withColumns(
        {
            "__from": F.array_position("__groups", F.col("group_id")).cast("int") - 1,
            "__own": F.size(F.filter("__groups", lambda g: g == F.col("group_id"))),
        }
    )
    df = df.withColumn("__near", planar.players_about(ax, ay, bx, by, cx, cy, F.col("__turn"), F.col("__xs"), F.col("__ys"), F.col("__from"), F.col("__own")))
    sides = [F.col("__ab"), F.col("__bc"), F.col("__ca")]
    inside = F.col("__near.inside")
    return df.select(
        *keys,
        "group_id",
        *[F.col(f"{k}.object_id").alias(f"player_{k}_id") for k in "abc"],
        "area_m2",
        (F.greatest(*sides) / F.least(*sides)).alias("aspect_ratio"),
        angle.alias("orientation_deg"),
        "centroid_x_m",
        "centroid_y_m",
        F.hypot(F.col("ball.x") * F.col("__turn") - mx, F.col("ball.y") * F.col("__turn") - my).alias("ball_distance_m"),
        zone(mx, my, F.col("__way"), length=length, width=width).alias("zone"),
        inside.alias("opponent_count_inside"),
        (inside / F.col("area_m2")).alias("opponent_density_per_m2"),
        F.get("__groups", F.col("__near.nearest")).alias("nearest_team_at_centroid"),
        (F.col("__near.other_m") - F.col("__near.own_m")).alias("nearest_team_distance_margin_m"),
    )


# -- territory and influence -----------------------------------------------------------


def territory(rows: DataFrame, keys: Sequence[str] = FRAME, *, length: float = 105.0, width: float = 68.0, outline: bool = True) -> DataFrame:
    """Cell of each player inside the pitch: area, share, outline and area per third."""
    packed = pack(rows, keys, ("object_id", "group_id", "x_m", "y_m"))
    cells = planar.cells_of(length, width, outline)(F.transform("players", lambda p: p["x_m"]), F.transform("players", lambda p: p["y_m"]))
    made = packed.withColumn("__c", cells)
    parts = [F.col(f"__c.{n}").alias(n) for n in ("area", "third_0", "third_1", "third_2", *(["polygon"] if outline else []))]
    zipped = made.select(*keys, F.inline(F.arrays_zip("players", *parts)))
    area = F.col("area")
    return zipped.select(
        *keys,
        F.col("players.object_id").alias("object_id"),
        F.col("players.group_id").alias("group_id"),
        area.alias("cell_area_m2"),
        (100.0 * area / (length * width)).alias("cell_percentage"),
        *[F.col(f"third_{i}").alias(f"frame_third_{i}_area_m2") for i in range(3)],
        *([F.col("polygon").alias("cell_polygon")] if outline else []),
    )


def territory_teams(cells: DataFrame, keys: Sequence[str] = FRAME, *, length: float = 105.0, width: float = 68.0) -> DataFrame:
    return cells.groupBy(*keys, "group_id").agg(
        F.count(F.lit(1)).alias("player_count"),
        F.sum("cell_area_m2").alias("controlled_area_m2"),
        (100.0 * F.sum("cell_area_m2") / (length * width)).alias("control_percentage"),
        *[F.sum(f"frame_third_{i}_area_m2").alias(f"frame_third_{i}_area_m2") for i in range(3)],
    )


def velocity_fallback(rows: DataFrame, *, vx: str | None = None, vy: str | None = None, max_gap_s: float = 0.25, chunk: int | None = DEFAULT_CHUNK_NS) -> DataFrame:
    """Provider velocity, else the first difference over a short enough gap, else zero; with its source."""
    given = F.lit(False) if vx is None else is_finite(vx) & is_finite(vy)
    given = F.coalesce(given, F.lit(False))

    def stage(w):
        dt = seconds(F.col("t_rel_ns") - F.lag("t_rel_ns").over(w))
        near = F.coalesce((dt > 0) & (dt <= max_gap_s), F.lit(False))
        source = F.when(given, "provider").when(near, "position_first_difference").otherwise("zero_fallback")
        speed = lambda own, axis: F.when(given, F.col(own) if own else F.lit(0.0)).when(near, (F.col(axis) - F.lag(axis).over(w)) / dt).otherwise(0.0)
        return {"velocity_x_m_s": speed(vx, "x_m"), "velocity_y_m_s": speed(vy, "y_m"), "velocity_source": source}

    return ordered.stencil(rows, ["stream_id", "group_id", "object_id"], ["t_rel_ns"], stage, ahead=0, chunk=chunk)


def influence_frames(
    moving: DataFrame,
    balls: DataFrame,
    sampled: DataFrame | None = None,
    keys: Sequence[str] = FRAME,
    *,
    length: float = 105.0,
    width: float = 68.0,
    grid_x: int = 21,
    grid_y: int = 14,
    reaction: float = 0.25,
    top_speed: float = 7.0,
    top_accel: float = 3.0,
) -> DataFrame:
    """Arrival-time model of every frame, packed; the readers below unpack what they need."""
    fields = ("group_id", "object_id", "x_m", "y_m", "velocity_x_m_s", "velocity_y_m_s", "velocity_source")
    frames = pack(moving, keys, fields).join(balls, list(keys), "left")
    due = F.lit(False)
    if sampled is not None:
        frames = frames.join(sampled.select(*keys).withColumn("__due", F.lit(True)), list(keys), "left")
        due = F.coalesce("__due", F.lit(False))
    each = lambda name: F.transform("players", lambda p: p[name])
    model = planar.influence_of(length, width, grid_x, grid_y, reaction, top_speed, top_accel)
    out = frames.withColumn(
        "model", model(each("x_m"), each("y_m"), each("velocity_x_m_s"), each("velocity_y_m_s"), each("group_id"), F.col("ball.x"), F.col("ball.y"), due)
    )
    return out.select(*keys, "players", "model", due.alias("grid_sampled"))


def player_influence(frames: DataFrame, keys: Sequence[str] = FRAME, *, length: float = 105.0, width: float = 68.0, cells: int = 294) -> DataFrame:
    zipped = frames.select(*keys, F.inline(F.arrays_zip("players", F.col("model.cells").alias("n"), F.col("model.opponent").alias("o"), F.col("model.ball").alias("b"))))
    return zipped.select(
        *keys,
        F.col("players.object_id").alias("object_id"),
        F.col("players.group_id").alias("group_id"),
        F.col("players.velocity_source").alias("velocity_source"),
        F.col("n").alias("grid_cells"),
        (F.col("n") * F.lit(length * width / cells)).alias("influence_area_m2"),
        (100.0 * F.col("n") / cells).alias("influence_percentage"),
        F.col("o").alias("opponent_min_arrival_time_s"),
        F.col("b").alias("arrival_time_to_ball_s"),
    )


def team_influence(each: DataFrame, keys: Sequence[str] = FRAME, *, length: float = 105.0, width: float = 68.0, cells: int = 294) -> DataFrame:
    """Cells per team; a team that owns none keeps its row."""
    return each.groupBy(*keys, "group_id").agg(
        F.count(F.lit(1)).alias("player_count"),
        F.sum("grid_cells").alias("grid_cells_controlled"),
        (F.sum("grid_cells") * F.lit(length * width / cells)).alias("controlled_area_m2"),
        (100.0 * F.sum("grid_cells") / cells).alias("influence_percentage"),
    )


def influence_grid(frames: DataFrame, keys: Sequence[str] = FRAME, *, length: float = 105.0, width: float = 68.0, grid_x: int = 21, grid_y: int = 14) -> DataFrame:
    """One row per grid cell of each sampled frame with its owner and arrival time."""
    due = frames.filter("grid_sampled")
    cells = due.select(*keys, "players", F.posexplode(F.arrays_zip(F.col("model.owner").alias("owner"), F.col("model.time").alias("time"))).alias("cell", "__c"))
    owner = F.get("players", F.col("__c.owner"))
    column, row = F.call_function("div", F.col("cell"), F.lit(grid_y)), F.col("cell") % grid_y
    return cells.select(
        *keys,
        column.cast("bigint").alias("cell_x"),
        row.cast("bigint").alias("cell_y"),
        ((column + 0.5) * (length / grid_x) - length / 2).alias("x_m"),
        ((row + 0.5) * (width / grid_y) - width / 2).alias("y_m"),
        owner["object_id"].alias("owner_object_id"),
        owner["group_id"].alias("owner_group_id"),
        F.col("__c.time").alias("arrival_time_s"),
    )


def frame_summary(df: DataFrame, keys: Sequence[str] = FRAME) -> DataFrame:
    """Players, extrapolated entities and whether the ball was detected, per frame."""
    is_ball = F.col("object_type") == "ball"
    return df.groupBy(*keys).agg(
        F.count_if(~is_ball).alias("players"),
        F.count_if(F.coalesce(~F.col("is_detected"), F.lit(False))).alias("extrapolated"),
        F.bool_or(F.when(is_ball, F.col("is_detected"))).alias("ball_detected"),
    )
