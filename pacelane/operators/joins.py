"""Joins by time, clock and identity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pacelane.operators import ordered

DEFAULT_CHUNK_NS = 600_000_000_000
SPREAD = 1024


def left_lookup(left: DataFrame, right: DataFrame, on: Sequence[str], spread_by: str) -> DataFrame:
    """Left equi join in which rows without a complete key do not meet in one task.

    Such rows can never match; without the extra key they would all hash alike.
    """
    missing = F.lit(False)
    for c in on:
        missing = missing | F.col(c).isNull()
    salted = left.withColumn("__salt", F.when(missing, F.pmod(F.xxhash64(spread_by), F.lit(SPREAD)) + 1).otherwise(F.lit(0).cast("bigint")))
    return salted.join(right.withColumn("__salt", F.lit(0).cast("bigint")), [*on, "__salt"], "left").drop("__salt")


def exact_time_join(left: DataFrame, right: DataFrame, identity: Sequence[str], time: str) -> DataFrame:
    """Rows of both streams with the same identity and the identical time; nothing is interpolated."""
    return left.join(right, [*identity, time])


def nearest_event_join(
    events: DataFrame, frames: DataFrame, keys: Sequence[str], time: str, out: str = "frame_ns", *, chunk: int | None = DEFAULT_CHUNK_NS
) -> DataFrame:
    """Every event with the time of its nearest frame; a tie goes to the earlier frame.

    Both sides are merged on the time axis and the frame times before and after
    each event are carried to it, so there is no pairing of events and frames.
    """
    keys = list(keys)
    payload = F.struct(*events.columns)
    ticks = frames.select(*keys, F.col(time).alias("__t")).distinct()
    axis = events.select(*keys, F.col(time).alias("__t"), F.lit(1).alias("__kind"), payload.alias("__event")).unionByName(
        ticks.select(*keys, "__t", F.lit(0).alias("__kind")), allowMissingColumns=True
    )
    mark = F.when(F.col("__kind") == 0, F.col("__t"))
    around = ordered.running(axis, keys, ["__t", "__kind"], chunk=chunk, lasts={"__before": mark}, nexts={"__after": mark})
    before, after, t = F.col("__before"), F.col("__after"), F.col("__t")
    chosen = F.when(before.isNull(), after).when(after.isNull(), before).when(t - before <= after - t, before).otherwise(after)
    return around.filter(F.col("__kind") == 1).select("__event.*", chosen.alias(out))


def latest_at_or_before(
    left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, max_age: int, out: str = "source_ns", *, chunk: int | None = DEFAULT_CHUNK_NS
) -> DataFrame:
    """Every left row with the newest right time not after it and not older than ``max_age``."""
    keys = list(keys)
    axis = left.select(*keys, F.col(time).alias("__t"), F.lit(1).alias("__kind"), F.struct(*left.columns).alias("__left")).unionByName(
        right.select(*keys, F.col(time).alias("__t")).distinct().withColumn("__kind", F.lit(0)), allowMissingColumns=True
    )
    carried = ordered.running(axis, keys, ["__t", "__kind"], chunk=chunk, lasts={"__seen": F.when(F.col("__kind") == 0, F.col("__t"))})
    fresh = F.when(F.col("__t") - F.col("__seen") <= max_age, F.col("__seen"))
    return carried.filter(F.col("__kind") == 1).select("__left.*", fresh.alias(out))


def event_snapshot(
    events: DataFrame,
    tracking: DataFrame,
    keys: Sequence[str],
    time: str = "t_rel_ns",
    *,
    max_delta_ns: int = 40_000_000,
    keep_unsynchronized: bool = True,
    chunk: int | None = DEFAULT_CHUNK_NS,
) -> DataFrame:
    """Events with the facts of their nearest tracking frame when it is close enough.

    A frame too far away leaves NULL positions and zero counts; the event stays.
    """
    keys = list(keys)
    player = F.col("object_type").isin("player", "goalkeeper")
    ball = F.col("object_type") == "ball"
    frame = tracking.groupBy(*keys, F.col(time).alias("frame_ns")).agg(
        F.count(F.lit(1)).alias("__entities"),
        F.count_if(player).alias("__players"),
        F.countDistinct(F.when(player, F.col("group_id"))).alias("__teams"),
        F.min(F.when(ball, F.struct("sample_index", "x_m", "y_m"))).alias("__ball"),
    )
    matched = nearest_event_join(events, tracking, keys, time, "__frame", chunk=chunk)
    delta = F.abs(F.col("__frame") - F.col(time))
    matched = matched.withColumns({"sync_delta_ns": delta, "synchronized": F.coalesce(delta <= max_delta_ns, F.lit(False))})
    matched = matched.withColumn("frame_ns", F.when(F.col("synchronized"), F.col("__frame"))).drop("__frame")
    out = left_lookup(matched, frame, [*keys, "frame_ns"], "event_id")
    zero = F.lit(0).cast("bigint")
    out = out.select(
        *events.columns,
        "sync_delta_ns",
        "synchronized",
        F.col("frame_ns").alias("tracking_t_rel_ns"),
        F.coalesce("__entities", zero).alias("tracking_entity_count"),
        F.coalesce("__players", zero).alias("tracking_player_count"),
        F.coalesce("__teams", zero).alias("tracking_team_count"),
        F.col("__ball.x_m").alias("ball_x_m"),
        F.col("__ball.y_m").alias("ball_y_m"),
        F.hypot(F.col("x_m") - F.col("__ball.x_m"), F.col("y_m") - F.col("__ball.y_m")).alias("event_ball_distance_m"),
    )
    return out if keep_unsynchronized else out.filter("synchronized")


# Link dispositions and reasons.
EXACT_FRAME, BY_CLOCK, UNLINKED = "exact_frame", "authoritative_time_clock", "legitimately_unlinked"
CONFLICT = "conflicting_exact_frame_and_wall_clock_keys"
AMBIGUOUS = "ambiguous_period_game_clock_key"
NO_KEY_RELATION = "no_temporal_key_on_relationship_record"
NO_KEY = "provider_temporal_keys_missing"
NO_FRAME = "no_exact_tracking_key"


def link_events_to_frames(events: DataFrame, clock: DataFrame, event_id: str = "event_no", *, keys: Sequence[str] = ()) -> DataFrame:
    """Link events to frames by frame index, then wall clock, then a unique game clock.

    Every event keeps a disposition; conflicting or ambiguous keys never link.  ``keys`` tell contests apart, whose frames and clocks repeat.
    """
    period = [*keys, "period_number"]
    frame = F.struct("frame_idx", "canonical_time_ns")
    by_index = clock.select(*period, F.col("frame_idx").alias("source_frame_idx"), frame.alias("__by_index"))
    by_wall = clock.select(*period, "wall_clock_ms", frame.alias("__by_wall"))
    known = clock.filter("game_clock_s IS NOT NULL")
    found = [F.count(F.lit(1)).alias("n"), F.min(frame).alias("f")]
    by_game = known.groupBy(*period, "game_clock_s").agg(*found).select(*period, "game_clock_s", F.struct("n", "f").alias("__by_game"))
    by_both = (
        known.filter("shot_clock_s IS NOT NULL").groupBy(*period, "game_clock_s", "shot_clock_s").agg(*found).select(*period, "game_clock_s", "shot_clock_s", F.struct("n", "f").alias("__by_both"))
    )
    out = left_lookup(events, by_index, [*period, "source_frame_idx"], event_id)
    out = left_lookup(out, by_wall, [*period, "wall_clock_ms"], event_id)
    out = left_lookup(out, by_game, [*period, "game_clock_s"], event_id)
    out = left_lookup(out, by_both, [*period, "game_clock_s", "shot_clock_s"], event_id)
    i, w = F.col("__by_index"), F.col("__by_wall")
    game = F.when(F.col("shot_clock_s").isNull(), F.col("__by_game")).otherwise(F.col("__by_both"))
    candidates = F.coalesce(game["n"], F.lit(0))
    conflict = F.coalesce(i["frame_idx"] != w["frame_idx"], F.lit(False))
    method = (
        F.when(conflict, None)
        .when(i.isNotNull(), "frameIdx")
        .when(w.isNotNull(), "wallClock")
        .when(F.col("game_clock_s").isNotNull() & (candidates == 1), "gameClock")
    )
    no_key = F.col("source_frame_idx").isNull() & F.col("wall_clock_ms").isNull() & F.col("game_clock_s").isNull()
    reason = (
        F.when(F.col("link_method").isNotNull(), None)
        .when(conflict, CONFLICT)
        .when(candidates > 1, AMBIGUOUS)
        .when(no_key & (F.col("family") == "chance_players"), NO_KEY_RELATION)
        .when(no_key, NO_KEY)
        .otherwise(NO_FRAME)
    )
    linked = F.when(F.col("link_method") == "frameIdx", i).when(F.col("link_method") == "wallClock", w).when(F.col("link_method") == "gameClock", game["f"])
    out = out.withColumn("link_method", method)
    out = out.withColumns(
        {
            "linked_frame_idx": linked["frame_idx"],
            "linked_time_ns": linked["canonical_time_ns"],
            "disposition": F.when(F.col("link_method").isNull(), UNLINKED).when(F.col("link_method") == "frameIdx", EXACT_FRAME).otherwise(BY_CLOCK),
            "unlinked_reason": reason,
        }
    )
    return out.drop("__by_index", "__by_wall", "__by_game", "__by_both")


def link_dispositions(linked: DataFrame) -> DataFrame:
    """Counts by family, disposition and reason with totals per level."""
    return linked.rollup("family", "disposition", "unlinked_reason").agg(F.count(F.lit(1)).alias("events"), F.grouping_id().alias("level"))


def period_of_event(events: DataFrame, periods: DataFrame, keys: Sequence[str], time: str, out: str = "period_id") -> DataFrame:
    """First period whose closed interval holds the event; NULL outside every period.

    A contest has a handful of periods, so they travel as one array per contest.
    """
    listed = periods.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("period_order", "start_ns", "end_ns", "period_id"))).alias("__periods"))
    inside = F.filter("__periods", lambda p: (p["start_ns"] <= F.col(time)) & (F.col(time) <= p["end_ns"]))
    return ordered.attach(events, listed, keys, time, "left").withColumn(out, F.get(inside, F.lit(0))["period_id"]).drop("__periods")


def derive_periods(boundaries: DataFrame, declared: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Periods from kick-off and whistle events, else from a declared length after kick-off."""
    joined = declared.join(boundaries, [*keys, "section"], "left")
    whole = F.col("start_ns").isNotNull() & F.col("end_ns").isNotNull()
    none = F.col("start_ns").isNull() & F.col("end_ns").isNull() & F.col("total_ms").isNotNull()
    return joined.select(
        *keys,
        "section",
        "period_id",
        "period_order",
        F.when(whole, F.col("start_ns")).when(none, F.col("kickoff_ns")).alias("start_ns"),
        F.when(whole, F.col("end_ns")).when(none, F.col("kickoff_ns") + F.col("total_ms") * 1_000_000).alias("end_ns"),
        F.when(whole, "provider").when(none, "fallback").alias("source"),
    ).filter("source IS NOT NULL")


def alias_resolve(df: DataFrame, aliases: DataFrame, column: str, out: str) -> DataFrame:
    """Canonical id of an alias, or the id itself."""
    lookup = aliases.select(F.col("alias_id").alias(column), F.col("canonical_id").alias("__canonical"))
    return df.join(lookup, column, "left").withColumn(out, F.coalesce("__canonical", column)).drop("__canonical")


def missing_parents(children: DataFrame, parents: DataFrame, on: Mapping[str, str], how: str = "rows") -> DataFrame:
    """Child rows whose reference is set but has no parent; ``how='ids'`` lists the ids only."""
    renamed = parents.select(*[F.col(p).alias(c) for c, p in on.items()]).distinct()
    present = F.lit(True)
    for c in on:
        present = present & F.col(c).isNotNull()
    orphans = children.filter(present)
    if how == "ids":
        orphans = orphans.select(*on).distinct()
    return orphans.join(renamed, list(on), "left_anti")


def consistent_map(df: DataFrame, key: str, value: str) -> DataFrame:
    """Distinct key to value pairs with ``is_conflict`` where a key has several values."""
    return df.filter(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key).agg(F.min(value).alias(value), (F.min(value) != F.max(value)).alias("is_conflict"))


def possession_context(frames: DataFrame, possession: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Frames with their possession row; frames with contradicting rows are flagged and left unknown."""
    value = F.struct(*fields)
    grouped = possession.groupBy(*keys).agg(F.min(value).alias("__low"), F.max(value).alias("__high"))
    joined = frames.join(grouped, list(keys), "left")
    conflict = F.coalesce(~F.col("__low").eqNullSafe(F.col("__high")), F.lit(False)) & F.col("__low").isNotNull()
    return joined.select(
        *frames.columns,
        conflict.alias("possession_conflict"),
        F.col("__low").isNotNull().alias("possession_present"),
        *[F.when(~conflict, F.col(f"__low.{f}")).alias(f) for f in fields],
    )


def coincidence(pose: DataFrame, tracking: DataFrame, *, keys: Sequence[str] = ()) -> DataFrame:
    """Player rows of frames both sources saw, contest by contest (``keys``): pose at 25 Hz, tracking at 10 Hz.

    Pose frame 5n shares its instant with tracking frame 2n.  Returned rows say
    which side saw the player and how far apart the two positions are.
    """
    sampled = pose.filter(F.col("frame") % 5 == 0).withColumn("frame", F.call_function("div", F.col("frame") * 2, F.lit(5).cast("bigint")))
    instant = [*keys, "frame"]
    head = lambda d, side: d.groupBy(*instant).agg(F.min("period").alias(f"{side}_period"), F.min("timestamp").alias(f"{side}_timestamp"))
    shared = head(sampled, "pose").join(head(tracking, "tracking"), instant).filter("pose_period IS NOT NULL AND tracking_period IS NOT NULL")
    spot = lambda d, side: d.select(*instant, "player_id", F.struct(F.lit(True).alias("seen"), "x", "y").alias(side))
    players = spot(sampled, "p").join(spot(tracking, "t"), [*instant, "player_id"], "full_outer")
    return shared.join(players, instant).select(
        *instant,
        F.col("pose_period").alias("period"),
        (F.col("pose_timestamp") == F.col("tracking_timestamp")).alias("timestamp_match"),
        "player_id",
        F.coalesce("p.seen", F.lit(False)).alias("in_pose"),
        F.coalesce("t.seen", F.lit(False)).alias("in_tracking"),
        F.hypot(F.col("p.x") - F.col("t.x"), F.col("p.y") - F.col("t.y")).alias("residual_m"),
    )


def frames_with_players(clock: DataFrame, tracking: DataFrame, roster: DataFrame, scale: Column, *, keys: Sequence[str] = ()) -> DataFrame:
    """Clock frames with their players and ball, contest by contest (``keys``); positions scaled for display."""
    positions = tracking.join(roster, [*keys, "object_id"], "left")
    person = F.struct(
        F.col("object_id"), F.coalesce("display_name", "object_id").alias("display_name"), "group_id", (F.col("x_m") * scale).alias("x"), (F.col("y_m") * scale).alias("y")
    )
    is_ball = F.col("object_type") == "ball"
    grouped = positions.groupBy(*keys, F.col("t_rel_ns").alias("canonical_time_ns")).agg(
        F.array_sort(F.collect_list(F.when(~is_ball, person))).alias("players"),
        F.min(F.when(is_ball, F.struct((F.col("x_m") * scale).alias("x"), (F.col("y_m") * scale).alias("y")))).alias("ball"),
    )
    return clock.join(grouped, [*keys, "canonical_time_ns"], "left")
