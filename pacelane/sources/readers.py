"""Provider files to canonical rows.

Every reader states its schema, reads all values it does not trust as text, and
returns good and bad rows together: ``rule`` says why a row is set aside and is
NULL on a good row, so one plan feeds both the stream and the quarantine.

One call reads the files of many contests.  Frames, clocks and player ids repeat from contest to contest, so ``keys`` name the columns
that tell contests apart: order, origins, rosters and lookups hold within a key.  ``contest``, a pattern with one group, takes
the key ``contest_id`` from the path of each file.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pacelane.functions.scalar import is_finite
from pacelane.operators import ordered
from pacelane.operators.clean import canonical_id, iso_ns, match_clock_ns, snake_case

FEET_TO_METRES = 0.3048
KMH_TO_MS = 1 / 3.6


def first_rule(*checks: tuple[Column, str]) -> Column:
    """Name of the first check that fails, NULL when none does."""
    out = F.lit(None).cast("string")
    for failed, rule in reversed(checks):
        out = F.when(F.coalesce(failed, F.lit(False)), rule).otherwise(out)
    return out


def behind(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, valid: Column, out: str, *, chunk: int) -> DataFrame:
    """True where a value does not pass the largest one of earlier valid rows.

    Accepted rows always advance, so the last accepted value is that maximum.
    """
    best = ordered.running(df, keys, order, chunk=chunk, maxima_before={"__before": F.when(valid, F.col(value))})
    return best.withColumn(out, F.coalesce(F.col(value) <= F.col("__before"), F.lit(False))).drop("__before")


def _number(text: Column) -> Column:
    return text.try_cast("double")


def keyed_by_path(files: DataFrame, contest: str | None) -> tuple[DataFrame, list[str]]:
    """A table read from files with ``contest_id``, the group of ``contest`` in its file's path (NULL where it is not found), and the key list."""
    if contest is None:
        return files, []
    return files.withColumn("contest_id", F.nullif(F.regexp_extract("_metadata.file_path", contest, 1), F.lit(""))), ["contest_id"]


def _files(spark: SparkSession, contest: str | None):
    """A reader; a folder for each contest is part of the path, not a partition column."""
    return spark.read.option("recursiveFileLookup", contest is not None)


def with_origin(df: DataFrame, origin: int | Column | DataFrame, keys: Sequence[str], by: str | Column) -> DataFrame:
    """``__origin`` of every row: one value, or that of the row's key in a table of ``keys`` and ``kickoff_ns`` (NULL without one)."""
    if isinstance(origin, DataFrame):
        return ordered.attach(df, origin.select(*keys, F.col("kickoff_ns").alias("__origin")), keys, by, "left")
    return df.withColumn("__origin", origin if isinstance(origin, Column) else F.lit(origin))


def side_names(df: DataFrame, sides: Mapping[str, str] | DataFrame, keys: Sequence[str], by: str | Column) -> DataFrame:
    """``__sides``, a map from the source's side name to a team id: one for all rows, or that of the row's key in a table of ``keys``, ``side``, ``team_id``."""
    if isinstance(sides, DataFrame):
        listed = sides.groupBy(*keys).agg(F.map_from_entries(F.collect_set(F.struct("side", "team_id"))).alias("__sides"))
        return ordered.attach(df, listed, keys, by, "left")
    return df.withColumn("__sides", F.create_map(*[F.lit(v) for p in sides.items() for v in p]))


# -- position sheets ---------------------------------------------------------------


GNSS_COLUMNS = ("sheet", "row_no", "local_time", "latitude", "longitude", "speed_kmh")


def read_gnss_rows(spark: SparkSession, path: str, *, contest: str | None = None, chunk: int = 100_000) -> DataFrame:
    """Position rows exported as CSV (sheet, row number, local time, latitude, longitude, km/h)."""
    schema = ", ".join(f"{c} string" for c in GNSS_COLUMNS)
    raw, keys = keyed_by_path(_files(spark, contest).schema(schema).option("header", True).csv(path), contest)
    return gnss_rows(raw, keys=keys, chunk=chunk)


def gnss_rows(raw: DataFrame, *, keys: Sequence[str] = (), chunk: int = 100_000) -> DataFrame:
    """Samples of all sheets; the first time of a key's sheets is its origin."""
    time = F.when(F.col("local_time").rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{3}$"), F.unix_micros(F.try_to_timestamp("local_time")) * 1000)
    lat, lon, speed = _number(F.col("latitude")), _number(F.col("longitude")), _number(F.col("speed_kmh"))
    df = raw.withColumns({"row_no": F.col("row_no").try_cast("bigint"), "__t": time, "latitude_deg": lat, "longitude_deg": lon, "__v": speed})
    absent = F.col("latitude").isNull() | F.col("longitude").isNull() | F.col("sheet").isNull() | F.col("row_no").isNull()
    off = lat.isNull() | lon.isNull() | F.isnan(lat) | F.isnan(lon) | ~lat.between(-90, 90) | ~lon.between(-180, 180)
    bad_speed = F.col("speed_kmh").isNotNull() & ~F.coalesce(is_finite(speed), F.lit(False))
    df = df.withColumn("__later", first_rule((absent, "required_field_null"), (off, "coordinate_out_of_range"), (bad_speed, "non_finite_value")))
    usable = F.col("__t").isNotNull() & F.col("__later").isNull()
    df = behind(df, [*keys, "sheet"], ["row_no"], "__t", usable, "__behind", chunk=chunk)
    origin = df.groupBy(*keys).agg(F.min("__t").alias("__origin"))
    df = ordered.attach(df, origin, keys, F.xxhash64("sheet", "row_no"), "left") if keys else df.join(F.broadcast(origin))  # one row
    rule = F.coalesce(first_rule((F.col("__t").isNull(), "timestamp_unparsable"), (F.col("__behind"), "time_out_of_range")), F.col("__later"))
    return df.select(*keys, "sheet", "row_no", (F.col("__t") - F.col("__origin")).alias("t_rel_ns"), "latitude_deg", "longitude_deg", (F.col("__v") * KMH_TO_MS).alias("speed_m_s"), rule.alias("rule"))


# -- positions, events and match XML --------------------------------------------------

POSITION_SCHEMA = "_GameSection string, _TeamId string, _PersonId string, Frame array<struct<_N: string, _T: string, _X: string, _Y: string, _Z: string>>"
# Sections, the ball's team, and attributes that name the actor.
SECTIONS = {"firstHalf": "period-1", "secondHalf": "period-2"}
BALL_TEAM = "BALL"
PLAYER_ATTRIBUTE = {"SavedShot": "GoalKeeper", "TacklingGame": "Winner", "Foul": "Fouler", "Substitution": "PlayerIn"}
TEAM_ATTRIBUTE = {"TacklingGame": "WinnerTeam", "Foul": "TeamFouler"}
BODY_PARTS = {"leftLeg": "left_leg", "rightLeg": "right_leg", "head": "head"}
MAPPED_ATTRIBUTES = ("EventId", "EventTime", "MatchId", "GameSection", "X-Position", "Y-Position")


def read_positions_xml(spark: SparkSession, path: str, kickoff_ns: int | Column | DataFrame, *, contest: str | None = None, chunk: int = 10_000) -> DataFrame:
    """25 Hz positions: one FrameSet per person and half, one Frame per tick."""
    sets, keys = keyed_by_path(_files(spark, contest).format("xml").option("rowTag", "FrameSet").schema(POSITION_SCHEMA).load(path), contest)
    return position_rows(sets, kickoff_ns, keys=keys, chunk=chunk)


def position_rows(
    sets: DataFrame, kickoff_ns: int | Column | DataFrame, *, keys: Sequence[str] = (), frame_ns: int = 40_000_000, tolerance_ns: int = 1_000_000, chunk: int = 10_000
) -> DataFrame:
    """Tracking rows; a row whose contest has no kick-off has no time and is set aside."""
    identity = [*keys, "section", "team_id", "person_id"]
    rows = sets.select(*keys, F.col("_GameSection").alias("section"), F.col("_TeamId").alias("team_id"), F.col("_PersonId").alias("person_id"), F.posexplode("Frame").alias("pos", "f"))
    number = F.col("f._N").try_cast("bigint")
    x, y, z = _number(F.col("f._X")), _number(F.col("f._Y")), _number(F.col("f._Z"))
    df = rows.select(*identity, F.col("pos").cast("bigint").alias("pos"), "f", number.alias("frame"), iso_ns(F.col("f._T")).alias("utc_ns"), x.alias("x_m"), y.alias("y_m"), z.alias("z_m"))
    first = df.filter("frame IS NOT NULL AND utc_ns IS NOT NULL").groupBy(*keys, "section").agg(F.min(F.struct("frame", "utc_ns")).alias("__first"))
    spread = F.xxhash64("person_id", "pos")
    df = with_origin(ordered.attach(df, first, [*keys, "section"], spread, "left"), kickoff_ns, keys, spread)
    expected = F.col("__first.utc_ns") + (F.col("frame") - F.col("__first.frame")) * frame_ns
    drift = F.abs(expected - F.col("utc_ns")) > tolerance_ns
    missing = F.col("f._X").isNull() | F.col("f._Y").isNull()
    text = F.col("x_m").isNull() | F.col("y_m").isNull() | (F.col("f._Z").isNotNull() & F.col("z_m").isNull())
    infinite = ~is_finite("x_m") | ~is_finite("y_m") | (F.col("z_m").isNotNull() & ~is_finite("z_m"))
    early = first_rule(
        (F.col("frame").isNull(), "required_field_null"), (F.col("f._T").isNull(), "required_field_null"), (F.col("utc_ns").isNull(), "timestamp_unparsable"), (drift, "frame_time_mismatch"),
        (F.col("__origin").isNull(), "required_field_null"),
    )
    late = first_rule((missing, "coordinate_missing"), (text, "coordinate_out_of_range"), (infinite, "non_finite_value"))
    # From here on without the texts of the frames, which would be sorted along.
    df = df.select(*identity, "pos", "frame", "utc_ns", "__origin", "x_m", "y_m", "z_m", early.alias("__early"), late.alias("__late"))
    df = behind(df, identity, ["pos"], "frame", F.col("__early").isNull() & F.col("__late").isNull(), "__behind", chunk=chunk)
    is_ball = F.col("team_id") == BALL_TEAM
    return df.select(
        *keys,
        F.try_element_at(F.create_map(*[F.lit(v) for p in SECTIONS.items() for v in p]), F.col("section")).alias("trial_id"),
        F.col("person_id").alias("object_id"),
        F.when(is_ball, "ball").otherwise("player").alias("object_type"),
        F.when(~is_ball, F.col("team_id")).alias("group_id"),
        "frame",
        (F.col("utc_ns") - F.col("__origin")).alias("t_rel_ns"),
        "x_m",
        "y_m",
        "z_m",
        F.coalesce("__early", F.when(F.col("__behind"), "duplicate_frame"), "__late").alias("rule"),
    )


def read_events_xml(spark: SparkSession, path: str, kickoff_ns: int | DataFrame, *, contest: str | None = None) -> DataFrame:
    """Event rows; the text is split at event ends, so a large document is read by many tasks."""
    raw, keys = keyed_by_path(_files(spark, contest).option("lineSep", "</Event>").text(path), contest)
    return event_rows(raw, kickoff_ns, keys=keys)


def event_rows(raw: DataFrame, kickoff_ns: int | DataFrame, *, keys: Sequence[str] = ()) -> DataFrame:
    """Type from the first child, subtype from its deepest first child, attributes from the whole chain."""
    pieces = raw.select(*keys, F.explode(F.regexp_extract_all("value", F.lit(r"(?s)(<Event\b[^>]*/>|<Event\b.*$)"), F.lit(1))).alias("xml"))
    plain = F.regexp_replace("xml", r"(?s)<!--.*?-->", "")
    head = F.regexp_extract(plain, r"(?s)^<Event\b([^>]*)>", 1)
    body = F.regexp_replace(plain, r"(?s)^<Event\b[^>]*>", "")
    pairs = lambda text: F.arrays_zip(
        F.regexp_extract_all(text, F.lit(r'([A-Za-z_][\w.-]*)\s*=\s*"([^"]*)"'), F.lit(1)).alias("k"), F.regexp_extract_all(text, F.lit(r'([A-Za-z_][\w.-]*)\s*=\s*"([^"]*)"'), F.lit(2)).alias("v")
    )
    df = pieces.select(*keys, pairs(head).alias("own"), pairs(body).alias("chain"), F.regexp_extract(body, r"^\s*<([A-Za-z_][\w.-]*)", 1).alias("primary"), body.alias("body"))
    # The deepest first child is the last element opened before the first one closes.
    opened = F.regexp_extract(F.col("body"), r"(?s)^((?:\s*<[A-Za-z_][^>/]*(?:/(?!>)[^>/]*)*>)*\s*(?:<[A-Za-z_][^>]*/>)?)", 1)
    names = F.regexp_extract_all(opened, F.lit(r"<([A-Za-z_][\w.-]*)"), F.lit(1))
    deepest = F.get(names, F.size(names) - 1)

    def plain_text(text: Column) -> Column:
        for code, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
            text = F.replace(text, F.lit(code), F.lit(sign))
        return text

    def value(field: str, name: str | Column) -> Column:
        wanted = F.lit(name) if isinstance(name, str) else name
        found = F.filter(field, lambda a: a["k"] == wanted)
        return plain_text(F.get(found, F.size(found) - 1)["v"])

    actor = lambda special, default: F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for p in special.items() for v in p]), F.col("primary")), F.lit(default))
    when = value("own", "EventTime")
    x, y = _number(value("own", "X-Position")), _number(value("own", "Y-Position"))
    placed = value("own", "X-Position").isNotNull() & value("own", "Y-Position").isNotNull()
    every = F.concat("own", "chain")
    names_kept = F.array_sort(F.array_distinct(F.transform(F.filter(every, lambda a: ~a["k"].isin(*MAPPED_ATTRIBUTES)), lambda a: a["k"])))
    last_of = lambda k: plain_text(F.element_at(F.filter(every, lambda a: a["k"] == k), -1)["v"])
    context = F.map_from_arrays(names_kept, F.transform(names_kept, last_of))
    out = df.select(
        *keys,
        value("own", "EventId").alias("event_id"),
        when.alias("event_time"),
        iso_ns(when).alias("utc_ns"),
        "primary",
        value("chain", "GameSection").alias("section"),
        snake_case("primary").alias("event_type"),
        F.when(deepest != F.col("primary"), snake_case(deepest)).alias("event_subtype"),
        value("chain", actor(TEAM_ATTRIBUTE, "Team")).alias("provider_team_id"),
        value("chain", actor(PLAYER_ATTRIBUTE, "Player")).alias("provider_player_id"),
        F.when(placed, x).alias("x_m"),
        F.when(placed, y).alias("y_m"),
        F.try_element_at(F.create_map(*[F.lit(v) for p in BODY_PARTS.items() for v in p]), value("chain", "TypeOfShot")).alias("body_part"),
        value("chain", "Evaluation").alias("outcome"),
        F.to_json(context).alias("provider_context_json"),
        placed.alias("placed"),
    ).filter("primary <> 'Delete' OR event_id IS NULL OR utc_ns IS NULL")
    out = with_origin(out, kickoff_ns, keys, F.xxhash64("event_id", "utc_ns"))
    rule = first_rule(
        (F.col("event_id").isNull() | F.col("event_time").isNull() | F.col("__origin").isNull(), "required_field_null"),
        (F.col("utc_ns").isNull(), "timestamp_unparsable"),
        (F.col("primary") == "", "schema_failure"),
        (F.col("placed") & (F.col("x_m").isNull() | F.col("y_m").isNull()), "coordinate_out_of_range"),
        (F.col("placed") & (~is_finite("x_m") | ~is_finite("y_m")), "non_finite_value"),
    )
    return out.withColumns({"t_rel_ns": F.col("utc_ns") - F.col("__origin"), "rule": rule}).drop("placed", "event_time", "__origin")


TEAM_SCHEMA = "_TeamId string, _TeamName string, _Role string, _LineUp string, Players struct<Player: array<struct<_PersonId: string, _ShirtNumber: string, _FirstName: string, _LastName: string, _Shortname: string, _Starting: string, _PlayingPosition: string, _TeamLeader: string>>>"


def read_match_info(spark: SparkSession, path: str, *, contest: str | None = None) -> DataFrame:
    """Teams and players of match information documents, one row per player."""
    teams, keys = keyed_by_path(_files(spark, contest).format("xml").option("rowTag", "Team").schema(TEAM_SCHEMA).load(path), contest)
    return match_info_rows(teams, keys=keys)


def match_info_rows(teams: DataFrame, *, keys: Sequence[str] = ()) -> DataFrame:
    yes = lambda c: F.lower(F.coalesce(F.col(c), F.lit("false"))) == "true"
    rows = teams.select(*keys, F.col("_TeamId").alias("team_id"), F.col("_TeamName").alias("team_name"), F.col("_Role").alias("role"), F.explode("Players.Player").alias("p"))
    return rows.select(
        *keys, "team_id", "team_name", "role", F.col("p._PersonId").alias("person_id"), F.col("p._ShirtNumber").try_cast("int").alias("shirt_number"), F.col("p._Shortname").alias("short_name"),
        yes("p._Starting").alias("starting"), F.col("p._PlayingPosition").alias("playing_position"), yes("p._TeamLeader").alias("team_leader"),
    )


# -- tracking and pose JSON lines --------------------------------------------------------

TRACKING_SCHEMA = """line bigint, frame bigint, timestamp string, period int,
    player_data array<struct<player_id: string, x: double, y: double, is_detected: boolean>>,
    ball_data struct<x: double, y: double, z: double, is_detected: boolean>,
    possession struct<player_id: string, `group`: string>"""


def read_tracking_frames(spark: SparkSession, path: str, *, contest: str | None = None) -> tuple[DataFrame, list[str]]:
    """10 Hz JSON lines as frames, and the key list; ``line`` is the source order and part of every exported line."""
    return keyed_by_path(_files(spark, contest).schema(TRACKING_SCHEMA).json(path), contest)


def read_tracking_jsonl(spark: SparkSession, path: str, roster: DataFrame, *, contest: str | None = None, chunk: int = 10_000) -> DataFrame:
    frames, keys = read_tracking_frames(spark, path, contest=contest)
    return tracking_rows(frames, roster, keys=keys, chunk=chunk)


def tracking_rows(frames: DataFrame, roster: DataFrame, *, keys: Sequence[str] = (), chunk: int = 10_000) -> DataFrame:
    """One row per player and ball of each frame, with the rule a bad one breaks.

    ``roster`` holds the declared participants of each key (object_id, group_id, is_goalkeeper).
    """
    marked = ordered.stencil(frames, [*keys, "period"], ["line"], lambda w: {"__dup": F.coalesce(F.col("frame") <= F.lag("frame").over(w), F.lit(False))}, ahead=0, chunk=chunk)
    marked = marked.withColumn("t_rel_ns", match_clock_ns("timestamp"))
    item = lambda o, kind, x, y, z, d: F.struct(o.alias("object_id"), F.lit(kind).alias("kind"), x.alias("x_m"), y.alias("y_m"), z.alias("z_m"), d.alias("is_detected"))
    no_z = F.lit(None).cast("double")
    players = F.transform(F.coalesce("player_data", F.array().cast("array<struct<player_id: string, x: double, y: double, is_detected: boolean>>")), lambda p: item(p["player_id"], "player", p["x"], p["y"], no_z, p["is_detected"]))
    b = F.col("ball_data")
    has_ball = b.isNotNull() & (b["x"].isNotNull() | b["y"].isNotNull() | b["z"].isNotNull())
    ball = F.when(has_ball, F.array(item(F.lit("ball"), "ball", b["x"], b["y"], b["z"], b["is_detected"])))
    every = F.concat(players, F.coalesce(ball, F.slice(players, 1, 0)))
    rows = marked.select(*keys, "line", "frame", "period", "t_rel_ns", "__dup", F.inline(every))
    rows = rows.join(roster.withColumn("__known", F.lit(True)), [*keys, "object_id"], "left")
    is_ball = F.col("kind") == "ball"
    finite_xy = F.coalesce(is_finite("x_m") & is_finite("y_m"), F.lit(False))
    rule = first_rule(
        (F.col("t_rel_ns").isNull(), "timestamp_unparsable"),
        (F.col("__dup"), "duplicate_frame"),
        (~is_ball & F.col("__known").isNull(), "unknown_participant"),
        (~is_ball & ~finite_xy, "non_finite_value"),
        (is_ball & ~finite_xy, "coordinate_missing"),
        (is_ball & F.col("z_m").isNotNull() & ~is_finite("z_m"), "non_finite_value"),
    )
    kind = F.when(is_ball, "ball").when(F.col("is_goalkeeper"), "goalkeeper").otherwise("player")
    return rows.select(*keys, "line", "frame", "period", "t_rel_ns", "object_id", kind.alias("object_type"), "group_id", "x_m", "y_m", "z_m", "is_detected", rule.alias("rule"))


def possession_rows(frames: DataFrame, teams: Mapping[str, str] | DataFrame, wanted: DataFrame, *, keys: Sequence[str] = ()) -> DataFrame:
    """Possession of the wanted tracking times; the team comes from the source's side name (``side_names``)."""
    timed = frames.select(*keys, match_clock_ns("timestamp").alias("t_rel_ns"), "period", "possession").filter("t_rel_ns IS NOT NULL")
    instant = [*keys, "period", "t_rel_ns"]
    asked = side_names(timed.join(wanted.select(*instant).distinct(), instant, "left_semi"), teams, keys, "t_rel_ns")
    return asked.select(*instant, F.try_element_at("__sides", F.coalesce("possession.group", F.lit(""))).alias("team_id"), F.col("possession.player_id").alias("player_id"))


# The published landmark order of the pose source.
LANDMARKS = (
    "nose", "neck", "lEye", "rEye", "lEar", "rEar", "lShoulder", "rShoulder", "lElbow", "rElbow", "lWrist", "rWrist", "lThumb", "rThumb", "lPinky",
    "rPinky", "midHip", "lHip", "rHip", "lKnee", "rKnee", "lAnkle", "rAnkle", "lHeel", "rHeel", "lBigToe", "rBigToe", "lSmallToe", "rSmallToe",
)
POSE_SCHEMA = """frame bigint, timestamp string, period int,
    player_data array<struct<player_id: string, joints: map<string, struct<xyz: array<double>, p90_mae_cm: double>>>>"""


def read_pose_jsonl(spark: SparkSession, path: str, roster: DataFrame, *, contest: str | None = None) -> DataFrame:
    frames, keys = keyed_by_path(_files(spark, contest).schema(POSE_SCHEMA).json(path), contest)
    return pose_rows(frames, roster, keys=keys)


def pose_rows(frames: DataFrame, roster: DataFrame, landmarks: Sequence[str] = LANDMARKS, *, keys: Sequence[str] = ()) -> DataFrame:
    """One row per landmark of the published list and per extra name, with the rule a bad one breaks.

    A player without joints has no pose in that frame and yields no rows; a null
    landmark is unavailable, not missing.
    """
    players = frames.select(*keys, "frame", "period", match_clock_ns("timestamp").alias("t_rel_ns"), F.inline("player_data")).filter("joints IS NOT NULL")
    listed = F.array(*[F.lit(n) for n in landmarks])
    rows = players.withColumn("joint_name", F.explode(F.array_union(listed, F.map_keys("joints"))))
    point = F.try_element_at("joints", "joint_name")
    rows = rows.withColumns({"__p": point, "__present": F.map_contains_key("joints", F.col("joint_name"))}).drop("joints")
    rows = rows.join(roster.select(*keys, F.col("object_id").alias("player_id"), F.lit(True).alias("__known")), [*keys, "player_id"], "left")
    xyz = F.col("__p.xyz")
    at = lambda i: F.get(xyz, F.lit(i))
    nulls = F.size(F.filter(xyz, lambda v: v.isNull()))
    off = xyz.isNull() | (nulls == 3)
    error = F.col("__p.p90_mae_cm")
    rule = first_rule(
        (F.col("t_rel_ns").isNull(), "timestamp_unparsable"),
        (F.col("__known").isNull(), "unknown_participant"),
        (F.array_position(listed, F.col("joint_name")) == 0, "schema_failure"),
        (~F.col("__present"), "schema_failure"),
        (xyz.isNotNull() & (F.size(xyz) != 3), "schema_failure"),
        (xyz.isNotNull() & nulls.between(1, 2), "schema_failure"),
        (~off & ~(is_finite(at(0)) & is_finite(at(1)) & is_finite(at(2))), "non_finite_value"),
        (error.isNotNull() & (~is_finite(error) | (error < 0)), "non_finite_value"),
    )
    shown = lambda i: F.when(~off, at(i))
    return rows.select(
        *keys, "frame", "period", "t_rel_ns", F.col("player_id").alias("subject_id"), "joint_name", (F.array_position(listed, F.col("joint_name")) - 1).cast("int").alias("joint_id"),
        (~off).alias("is_available"), shown(0).alias("x_m"), shown(1).alias("y_m"), shown(2).alias("z_m"), (error * 0.01).alias("error_m"), rule.alias("rule"),
    )


MATCH_SCHEMA = """id string, date_time string, pitch_length double, pitch_width double, home_team struct<id: string, name: string>, away_team struct<id: string, name: string>,
    home_team_side array<string>, match_periods array<struct<period: int, name: string, start_frame: bigint, end_frame: bigint>>,
    players array<struct<id: string, team_id: string, short_name: string, number: int, player_role: struct<position_group: string, name: string, acronym: string>>>"""


def read_match_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MATCH_SCHEMA).option("multiLine", True).json(path)


def match_players(matches: DataFrame) -> DataFrame:
    """Declared players with the rule a bad record breaks: no id, a repeated id or a foreign team."""
    rows = matches.select(F.col("id").alias("match_id"), F.col("home_team.id").alias("__h"), F.col("away_team.id").alias("__a"), F.posexplode("players").alias("__i", "p"))
    seen = rows.groupBy("match_id", F.col("p.id").alias("__id")).agg(F.min("__i").alias("__first"))
    joined = rows.withColumn("__id", F.col("p.id")).join(seen, ["match_id", "__id"], "left")
    rule = first_rule((F.col("__id").isNull(), "required_field_null"), (F.col("__i") > F.col("__first"), "duplicate_identity"), (~F.col("p.team_id").isin(F.col("__h"), F.col("__a")) | F.col("p.team_id").isNull(), "schema_failure"))
    return joined.select(
        "match_id", F.col("__id").alias("object_id"), F.col("p.team_id").alias("group_id"), F.when(F.col("p.team_id") == F.col("__h"), "home").otherwise("away").alias("side"), F.col("p.number").alias("shirt_number"),
        F.col("p.player_role.position_group").alias("position_group"), (F.col("p.player_role.acronym") == "GK").alias("is_goalkeeper"), rule.alias("rule"),
    )


def match_periods(matches: DataFrame) -> DataFrame:
    """Periods with the direction each side attacks, when the source declares it."""
    rows = matches.select(F.col("id").alias("match_id"), "home_team_side", F.inline("match_periods"))
    home = F.get("home_team_side", F.col("period") - 1)
    away = F.when(home == "left_to_right", "right_to_left").when(home == "right_to_left", "left_to_right")
    name = F.coalesce("name", F.concat(F.lit("period_"), F.col("period").cast("string")))
    return rows.select("match_id", "period", name.alias("name"), "start_frame", "end_frame", home.alias("home_direction"), away.alias("away_direction"), (F.col("end_frame") < F.col("start_frame")).alias("is_reversed"))


# -- basketball frames and events -----------------------------------------------------------

COURT_PLAYER = "struct<playerId: string, xyz: array<double>, isDetected: int>"
COURT_SCHEMA = f"""frameIdx bigint, period int, wallClock bigint, gameClock double, shotClock double, gameClockStopped boolean,
    homePlayers array<{COURT_PLAYER}>, awayPlayers array<{COURT_PLAYER}>, ball struct<xyz: array<double>, isDetected: int>"""


def read_court_frames(spark: SparkSession, path: str, *, contest: str | None = None) -> DataFrame:
    """Frames of court files, with ``contest_id`` if a pattern is given."""
    return keyed_by_path(_files(spark, contest).schema(COURT_SCHEMA).json(path), contest)[0]


def frame_clock(frames: DataFrame, *, keys: Sequence[str] = ()) -> DataFrame:
    """Clock index of every frame, dead time included."""
    count = lambda c: F.coalesce(F.size(c), F.lit(0))
    players = F.when(F.col("homePlayers").isNull(), 0).otherwise(count("homePlayers")) + F.when(F.col("awayPlayers").isNull(), 0).otherwise(count("awayPlayers"))
    ball = F.coalesce(F.size("ball.xyz") >= 2, F.lit(False)) & F.col("ball.xyz").isNotNull()
    out = frames.select(
        *keys, F.col("frameIdx").alias("frame_idx"), F.col("period").alias("period_number"), F.col("wallClock").alias("wall_clock_ms"), (F.col("wallClock") * 1_000_000).alias("canonical_time_ns"),
        F.col("gameClock").alias("game_clock_s"), F.col("gameClockStopped").alias("game_clock_stopped"), F.col("shotClock").alias("shot_clock_s"), players.alias("player_count"), ball.alias("ball_present"),
    )
    return out.withColumn("is_dead_time", (F.col("player_count") == 0) & ~F.col("ball_present"))


def court_tracking(frames: DataFrame, namespace: str, aliases: DataFrame, teams: Mapping[str, str] | DataFrame, *, keys: Sequence[str] = ()) -> DataFrame:
    """Home, away and ball positions in metres, with canonical subjects behind aliases; teams by side (``side_names``), aliases by key if they have it."""
    frames = side_names(frames, teams, keys, F.xxhash64("period", "frameIdx"))
    side = lambda c, name: F.transform(
        F.coalesce(F.col(c), F.array().cast(f"array<{COURT_PLAYER}>")), lambda p: F.struct(p["playerId"].alias("object_id"), F.lit("player").alias("object_type"), F.try_element_at("__sides", F.lit(name)).alias("group_id"), p["xyz"].alias("xyz"), p["isDetected"].alias("d"))
    )
    no_group = F.lit(None).cast("string")
    ball = F.when(F.size("ball.xyz") >= 2, F.array(F.struct(F.lit("ball").alias("object_id"), F.lit("ball").alias("object_type"), no_group.alias("group_id"), F.col("ball.xyz").alias("xyz"), F.col("ball.isDetected").alias("d"))))
    home = side("homePlayers", "home")
    every = F.concat(home, side("awayPlayers", "away"), F.coalesce(ball, F.slice(home, 1, 0)))
    rows = frames.select(*keys, F.col("period").alias("period_number"), (F.col("wallClock") * 1_000_000).alias("t_rel_ns"), F.inline(every))
    alike = [k for k in keys if k in aliases.columns]
    rows = rows.join(aliases.select(*alike, F.col("alias_id").alias("object_id"), "canonical_id"), [*alike, "object_id"], "left")
    person = canonical_id(namespace, "subject", F.coalesce("canonical_id", "object_id"))
    metres = lambda i: F.get("xyz", F.lit(i)) * FEET_TO_METRES
    return rows.select(
        *keys, "period_number", "t_rel_ns", "object_id", "object_type", "group_id", F.when(F.col("object_type") == "player", person).alias("subject_id"), metres(0).alias("x_m"), metres(1).alias("y_m"), metres(2).alias("z_m"), (F.col("d") == 1).alias("is_detected")
    )


def read_dynamic_events(spark: SparkSession, path: str, *, contest: str | None = None) -> DataFrame:
    """Event families of a game document: an object whose members are arrays of records."""
    documents, keys = keyed_by_path(_files(spark, contest).option("wholetext", True).text(path), contest)
    return dynamic_event_rows(documents, keys=keys)


def dynamic_event_rows(documents: DataFrame, *, keys: Sequence[str] = ()) -> DataFrame:
    """One uniform row per record, keys resolved from their alternatives."""
    families = documents.select(*keys, F.explode(F.from_json("value", "map<string, string>")).alias("family", "records")).filter(F.trim("records").startswith("["))
    rows = families.select(*keys, "family", F.posexplode(F.from_json("records", "array<string>")).alias("family_index", "payload_json"))
    pick = lambda *names: F.coalesce(*[F.get_json_object("payload_json", f"$.{n}") for n in names])
    event, period = pick("id", "eventId", "event_id"), pick("period", "periodNumber")
    return rows.select(
        *keys, "family", "family_index", F.concat(F.col("family"), F.lit(":"), F.lpad(F.col("family_index").cast("string"), 7, "0")).alias("sequence_index"), event.alias("source_event_id"), period.try_cast("int").alias("period_number"),
        pick("frameIdx", "frame", "startFrame", "start_frame", "endFrame", "end_frame").try_cast("bigint").alias("source_frame_idx"), pick("wallClock", "wall_clock", "startWallClock", "endWallClock").try_cast("bigint").alias("wall_clock_ms"),
        pick("gameClock", "game_clock", "startGameClock", "endGameClock").try_cast("double").alias("game_clock_s"), pick("shotClock", "shot_clock", "startShotClock", "endShotClock").try_cast("double").alias("shot_clock_s"),
        "payload_json", first_rule((event.isNull() | period.isNull(), "required_field_null")).alias("rule"),
    )


# -- seasons, leagues, trials and sets ----------------------------------------------------------


def read_season_csv(spark: SparkSession, path: str, metrics: Sequence[str], namespace: str, edition: str) -> DataFrame:
    """Season aggregates with canonical ids; identities as text, metrics as numbers."""
    identity = ["player_id", "player_name", "team_id", "team_name", "season_id", "position_group"]
    schema = ", ".join([f"{c} string" for c in identity] + [f"{m} double" for m in metrics])
    return season_rows(spark.read.schema(schema).option("header", True).csv(path), metrics, namespace, edition)


def season_rows(raw: DataFrame, metrics: Sequence[str], namespace: str, edition: str) -> DataFrame:
    rule = first_rule((F.col("player_id").isNull() | F.col("team_id").isNull(), "required_field_null"))
    return raw.select(
        F.concat_ws("/", F.lit(namespace), "player_id").alias("subject_id"), canonical_id(namespace, "team", F.col("team_id")).alias("team_id"), canonical_id(namespace, "edition", F.lit(edition)).alias("competition_edition_id"),
        "position_group", F.col("player_id").alias("provider_player_id"), F.col("team_id").alias("provider_team_id"), "player_name", *metrics, rule.alias("rule"),
    )


def expect_rows(df: DataFrame, expected: int) -> DataFrame:
    """The table, refused when its row count differs from the declared one."""
    found = df.count()
    if found != expected:
        raise ValueError(f"table has {found} rows; expected {expected}")
    return df


def read_league_assets(spark: SparkSession, paths: Mapping[str, str]) -> dict[str, DataFrame]:
    """Season tables of a league by family; provider columns keep their names behind ``src_``."""
    from pacelane.operators.clean import preserve_source

    return {family: preserve_source(spark.read.parquet(path)) for family, path in paths.items()}


TRIAL_SCHEMA = "session_id string, trial_id string, participant_id string, tracking array<struct<data: struct<player: map<string, array<double>>, ball: array<double>>>>"


def read_freethrow_json(spark: SparkSession, path: str, rate_hz: float) -> DataFrame:
    return freethrow_rows(spark.read.schema(TRIAL_SCHEMA).option("multiLine", True).json(path), rate_hz)


def freethrow_rows(trials: DataFrame, rate_hz: float) -> DataFrame:
    """One row per frame and keypoint of a trial; a keypoint may be absent, null or three feet values."""
    names = F.array_sort(F.array_distinct(F.flatten(F.transform("tracking", lambda f: F.map_keys(f["data"]["player"])))))
    frames = trials.select("session_id", "trial_id", F.col("participant_id").alias("subject_id"), names.alias("names"), F.posexplode("tracking").alias("frame", "f"))
    rows = frames.select("session_id", "trial_id", "subject_id", "frame", F.col("f.data.player").alias("player"), F.posexplode("names").alias("joint_id", "joint_name"))
    value = F.try_element_at("player", "joint_name")
    there = F.map_contains_key("player", F.col("joint_name"))
    at = lambda i: F.get(value, F.lit(i))
    finite = is_finite(at(0)) & is_finite(at(1)) & is_finite(at(2))
    state = F.when(~there, "absent").when(value.isNull(), "null").otherwise("present")
    rule = first_rule((value.isNotNull() & (F.size(value) != 3), "schema_failure"), (value.isNotNull() & ~F.coalesce(finite, F.lit(False)), "non_finite_value"))
    feet = lambda i: at(i) * FEET_TO_METRES
    return rows.select(
        "session_id", "trial_id", "subject_id", F.rint(F.col("frame") * (1e9 / rate_hz)).cast("bigint").alias("t_rel_ns"), "joint_id", "joint_name", value.isNotNull().alias("is_available"), state.alias("source_state"),
        feet(0).alias("x_m"), feet(1).alias("y_m"), feet(2).alias("z_m"), rule.alias("rule"),
    )


def jump_imu_rows(trials: DataFrame, rate_hz: int, gravity: float) -> DataFrame:
    """Acceleration samples (in g) of jump trials around take-off, in m/s²."""
    step = _step_ns(rate_hz)
    rows = trials.select("trial_id", "subject_id", "acc_takeoff", F.posexplode("acc_signals").alias("i", "a"))
    return rows.select("trial_id", "subject_id", F.col("i").cast("bigint").alias("sample_index"), ((F.col("i") - F.col("acc_takeoff")) * F.lit(step)).cast("bigint").alias("t_rel_ns"), *[(F.get("a", F.lit(k)) * gravity).alias(f"accel_{n}_m_s2") for k, n in enumerate("xyz")])


def jump_force_rows(trials: DataFrame, rate_hz: int) -> DataFrame:
    """Force samples in body weights; the record ends at take-off, which is time zero."""
    step = _step_ns(rate_hz)
    rows = trials.select("trial_id", "subject_id", F.size("grf_signals").alias("n"), F.posexplode("grf_signals").alias("i", "r"))
    return rows.select("trial_id", "subject_id", F.col("i").cast("bigint").alias("sample_index"), ((F.col("i") - F.col("n") + 1) * F.lit(step)).cast("bigint").alias("t_rel_ns"), F.col("r").cast("double").alias("force_z_body_weight_ratio"))


def _step_ns(rate_hz: int) -> int:
    if 1_000_000_000 % rate_hz:
        raise ValueError(f"source rate {rate_hz} Hz is not a whole number of nanoseconds")
    return 1_000_000_000 // rate_hz


def rep_trials(reps: DataFrame, video: DataFrame) -> DataFrame:
    """Repetition rows as trials: load from the export, else from the paired video row; a repeat is set aside.

    ``reps`` has set_number, line, rep_number (text), bar_weight (text like ``20kg``).
    """
    from pacelane.operators.clean import numeric_with_unit

    number = F.col("rep_number").try_cast("double")
    df = reps.withColumns({"__n": number, "__load": numeric_with_unit("bar_weight", "(?:kg)?")})
    good = F.coalesce(is_finite("__n"), F.lit(False))
    first = df.filter(good).groupBy("set_number", F.col("__n").cast("int").alias("__rep")).agg(F.min("line").alias("__first"))
    df = df.withColumn("__rep", F.when(good, F.col("__n").cast("int"))).join(first, ["set_number", "__rep"], "left").join(video, "set_number", "left")
    rule = first_rule((F.col("__n").isNull(), "schema_failure"), (~good, "non_finite_value"), (F.col("line") > F.col("__first"), "schema_failure"))
    return df.select(
        "set_number", "line", F.col("__rep").alias("rep_number"), F.coalesce("__load", "video_load_kg").alias("load_kg"), F.when(F.col("__load").isNotNull(), "export").when(F.col("video_load_kg").isNotNull(), "video").alias("load_source"), rule.alias("rule")
    )


def rep_observations(reps: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One row per repetition and metric; missing and non-finite values say so."""
    rows = reps.select(*keys, F.inline(F.array(*[F.struct(F.lit(m).alias("metric_id"), F.col(m).alias("value")) for m in metrics])))
    return rows.withColumn("rule", first_rule((F.col("value").isNull(), "required_field_null"), (~is_finite("value"), "non_finite_value")))


def read_file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """Name, SHA-256 and size of every file below a folder; Spark lists no empty file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("key"), F.sha2("content", 256).alias("found_sha256"), F.col("length").alias("found_bytes"))


def read_packed_hashes(spark: SparkSession, path: str) -> DataFrame:
    """Name, SHA-256 and size of every file kept in packs: Parquet rows of ``key`` and ``content``, the bytes of a file.

    Many small files are kept so, since making and listing one at a time costs a file system more than their bytes.
    """
    packs = spark.read.schema("key string, content binary").parquet(path)
    return packs.select("key", F.sha2("content", 256).alias("found_sha256"), F.octet_length("content").cast("bigint").alias("found_bytes"))


def compare_manifest(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """Retrieved files against their manifest: verified, missing, mismatched, wrong size or unlisted."""
    both = manifest.join(found, "key", "full_outer")
    status = (
        F.when(F.col("sha256").isNull() & F.col("size_bytes").isNull(), "unlisted")
        .when(F.col("found_sha256").isNull(), "missing")
        .when(F.col("sha256") != F.col("found_sha256"), "mismatched")
        .when(F.col("size_bytes") != F.col("found_bytes"), "size_mismatched")
        .otherwise("verified")
    )
    return both.select("key", status.alias("status"))


def verify_manifest(spark: SparkSession, path: str, manifest: DataFrame, *, packed: bool = False) -> DataFrame:
    """The files below a folder, or in the packs of it, hashed again and compared with their manifest."""
    return compare_manifest(manifest, read_packed_hashes(spark, path) if packed else read_file_hashes(spark, path))
