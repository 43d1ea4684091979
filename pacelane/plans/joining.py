"""Join queries over the stand-in tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pacelane.operators import joins, ranking
from pacelane.plans.registry import query, r6, rounded
from pacelane.testbed import SIGNAL_CHUNK, TRACK_CHUNK, contest_of

MS = 1_000_000


@query(
    "exact_time_join",
    "J1",
    "SELECT entity_id, t_rel_ns, round(f.ratio, 6) + 0.0 AS ratio, i.ax, i.ay FROM tb_force f JOIN tb_imu i USING (entity_id, t_rel_ns)",
)
def exact_time_join(tb):
    return joins.exact_time_join(tb.force, tb.imu, ["entity_id"], "t_rel_ns").select("entity_id", "t_rel_ns", r6("ratio").alias("ratio"), "ax", "ay")


@query(
    "nearest_event_join",
    "J2",
    """WITH fr AS (SELECT DISTINCT entity_id, t_rel_ns AS ft FROM tb_signal WHERE event_type = 'view')
       SELECT e.event_id, arg_min(ft, abs(ft - e.t_rel_ns) * 2 + CASE WHEN ft > e.t_rel_ns THEN 1 ELSE 0 END) AS frame_ns
       FROM tb_event e LEFT JOIN fr USING (entity_id) GROUP BY 1""",
)
def nearest_event_join(tb):
    frames = tb.signal.filter("event_type = 'view'")
    return joins.nearest_event_join(tb.event, frames, ["entity_id"], "t_rel_ns", chunk=SIGNAL_CHUNK).select("event_id", "frame_ns")


@query(
    "event_snapshot",
    "J3, J33",
    """WITH fr AS (SELECT stream_id, t_rel_ns AS ft, count(*) AS n, count(*) FILTER (object_type <> 'ball') AS pl, count(DISTINCT group_id) AS tm,
                    max(x_m) FILTER (object_type = 'ball') AS bx, max(y_m) FILTER (object_type = 'ball') AS bally FROM (SELECT * REPLACE (t_rel_ns + (frame // 3) * 80000000 AS t_rel_ns) FROM tb_frames) GROUP BY 1, 2),
       m AS (SELECT e.event_id, e.stream_id, any_value(e.t_rel_ns) AS t, any_value(e.x_m) AS x, any_value(e.y_m) AS y,
                    arg_min(ft, abs(ft - e.t_rel_ns) * 2 + CASE WHEN ft > e.t_rel_ns THEN 1 ELSE 0 END) AS ft FROM tb_source_event e LEFT JOIN fr USING (stream_id) GROUP BY 1, 2),
       s AS (SELECT *, abs(ft - t) AS d FROM m)
       SELECT s.event_id, s.stream_id, d AS sync_delta_ns, d <= 40000000 AS synchronized, fr.ft AS tracking_t_rel_ns, coalesce(n, 0) AS tracking_entity_count,
              coalesce(pl, 0) AS tracking_player_count, coalesce(tm, 0) AS tracking_team_count, round(bx, 6) + 0.0 AS ball_x_m, round(bally, 6) + 0.0 AS ball_y_m,
              round(sqrt((x - bx) ** 2 + (y - bally) ** 2), 6) + 0.0 AS event_ball_distance_m
       FROM s LEFT JOIN fr ON fr.stream_id = s.stream_id AND fr.ft = s.ft AND d <= 40000000""",
)
def event_snapshot(tb):
    gapped = tb.frames.withColumn("t_rel_ns", F.expr("t_rel_ns + (frame div 3) * 80000000"))  # three frames, then a gap
    df = joins.event_snapshot(tb.source_event, gapped, ["stream_id"], chunk=TRACK_CHUNK)
    df = df.select("event_id", "stream_id", "sync_delta_ns", "synchronized", "tracking_t_rel_ns", "tracking_entity_count", "tracking_player_count", "tracking_team_count", "ball_x_m", "ball_y_m", "event_ball_distance_m")
    return rounded(df, "ball_x_m", "ball_y_m", "event_ball_distance_m")


LINK_SQL = """
    WITH g AS (SELECT contest_id, period_number, game_clock_s, count(*) AS n, min(frame_idx) AS f FROM tb_frame_clock GROUP BY 1, 2, 3),
    gs AS (SELECT contest_id, period_number, game_clock_s, shot_clock_s, count(*) AS n, min(frame_idx) AS f FROM tb_frame_clock GROUP BY 1, 2, 3, 4),
    j AS (SELECT e.*, i.frame_idx AS fi, w.frame_idx AS fw, CASE WHEN e.shot_clock_s IS NULL THEN g.n ELSE gs.n END AS n, CASE WHEN e.shot_clock_s IS NULL THEN g.f ELSE gs.f END AS fg
          FROM tb_dynamic_event e
          LEFT JOIN tb_frame_clock i ON i.contest_id = e.contest_id AND i.period_number = e.period_number AND i.frame_idx = e.source_frame_idx
          LEFT JOIN tb_frame_clock w ON w.contest_id = e.contest_id AND w.period_number = e.period_number AND w.wall_clock_ms = e.wall_clock_ms
          LEFT JOIN g ON g.contest_id = e.contest_id AND g.period_number = e.period_number AND g.game_clock_s = e.game_clock_s
          LEFT JOIN gs ON gs.contest_id = e.contest_id AND gs.period_number = e.period_number AND gs.game_clock_s = e.game_clock_s AND gs.shot_clock_s = e.shot_clock_s),
    k AS (SELECT *, CASE WHEN fi <> fw THEN NULL WHEN fi IS NOT NULL THEN 'frameIdx' WHEN fw IS NOT NULL THEN 'wallClock' WHEN n = 1 THEN 'gameClock' END AS link_method FROM j),
    l AS (SELECT *, CASE link_method WHEN 'frameIdx' THEN fi WHEN 'wallClock' THEN fw WHEN 'gameClock' THEN fg END AS linked_frame_idx,
                 CASE WHEN link_method IS NULL THEN 'legitimately_unlinked' WHEN link_method = 'frameIdx' THEN 'exact_frame' ELSE 'authoritative_time_clock' END AS disposition,
                 CASE WHEN link_method IS NOT NULL THEN NULL WHEN fi <> fw THEN 'conflicting_exact_frame_and_wall_clock_keys' WHEN n > 1 THEN 'ambiguous_period_game_clock_key'
                      WHEN source_frame_idx IS NULL AND wall_clock_ms IS NULL AND game_clock_s IS NULL AND family = 'chance_players' THEN 'no_temporal_key_on_relationship_record'
                      WHEN source_frame_idx IS NULL AND wall_clock_ms IS NULL AND game_clock_s IS NULL THEN 'provider_temporal_keys_missing' ELSE 'no_exact_tracking_key' END AS unlinked_reason FROM k)"""


@query("link_events_to_frames", "J4", LINK_SQL + " SELECT contest_id, event_no, family, link_method, linked_frame_idx, linked_frame_idx * 40000000 AS linked_time_ns, disposition, unlinked_reason FROM l")
def link_events_to_frames(tb):
    return joins.link_events_to_frames(tb.dynamic_event, tb.frame_clock, keys=["contest_id"]).select("contest_id", "event_no", "family", "link_method", "linked_frame_idx", "linked_time_ns", "disposition", "unlinked_reason")


@query(
    "link_dispositions",
    "G44",
    LINK_SQL + " SELECT family, disposition, unlinked_reason, count(*) AS events, CAST(grouping_id(family, disposition, unlinked_reason) AS BIGINT) AS level FROM l GROUP BY ROLLUP (family, disposition, unlinked_reason)",
)
def link_dispositions(tb):
    return joins.link_dispositions(joins.link_events_to_frames(tb.dynamic_event, tb.frame_clock, keys=["contest_id"]))


PERIODS_SQL = """
    WITH b AS (SELECT user_id AS entity_id, CASE WHEN event_type = 'signup' THEN 'firstHalf' ELSE 'secondHalf' END AS section, min(t) AS start_ns, CASE WHEN user_id % 4 = 1 THEN NULL ELSE min(t) + 400000000000000 END AS end_ns
               FROM (SELECT entity_id AS user_id, event_type, t_rel_ns AS t FROM tb_signal) WHERE event_type IN ('signup', 'error') AND user_id % 4 <> 2 GROUP BY 1, 2),
    d AS (SELECT entity_id, section, period_order, CASE WHEN section = 'firstHalf' THEN 'period-1' ELSE 'period-2' END AS period_id, min(t_rel_ns) AS kickoff_ns,
                 CASE WHEN entity_id % 8 = 2 THEN NULL ELSE CAST(300000000 AS BIGINT) * period_order END AS total_ms
          FROM tb_signal, (VALUES ('firstHalf', 1), ('secondHalf', 2)) s(section, period_order) GROUP BY ALL),
    p AS (SELECT d.entity_id, d.section, d.period_id, d.period_order,
                 CASE WHEN start_ns IS NOT NULL AND end_ns IS NOT NULL THEN start_ns WHEN start_ns IS NULL AND end_ns IS NULL AND total_ms IS NOT NULL THEN kickoff_ns END AS start_ns,
                 CASE WHEN start_ns IS NOT NULL AND end_ns IS NOT NULL THEN end_ns WHEN start_ns IS NULL AND end_ns IS NULL AND total_ms IS NOT NULL THEN kickoff_ns + total_ms * 1000000 END AS end_ns,
                 CASE WHEN start_ns IS NOT NULL AND end_ns IS NOT NULL THEN 'provider' WHEN start_ns IS NULL AND end_ns IS NULL AND total_ms IS NOT NULL THEN 'fallback' END AS source
          FROM d LEFT JOIN b USING (entity_id, section))"""


def _periods(tb):
    marks = tb.signal.filter("event_type IN ('signup', 'error') AND entity_id % 4 <> 2").groupBy(
        "entity_id", F.expr("CASE WHEN event_type = 'signup' THEN 'firstHalf' ELSE 'secondHalf' END").alias("section")
    ).agg(F.min("t_rel_ns").alias("start_ns"))
    marks = marks.withColumn("end_ns", F.expr("CASE WHEN entity_id % 4 = 1 THEN NULL ELSE start_ns + 400000000000000 END"))
    halves = F.array(F.struct(F.lit("firstHalf").alias("section"), F.lit(1).alias("period_order")), F.struct(F.lit("secondHalf").alias("section"), F.lit(2).alias("period_order")))
    declared = tb.signal.groupBy("entity_id").agg(F.min("t_rel_ns").alias("kickoff_ns")).select("entity_id", "kickoff_ns", F.inline(halves)).withColumns(
        {
            "period_id": F.concat(F.lit("period-"), F.col("period_order").cast("string")),
            "total_ms": F.expr("CASE WHEN entity_id % 8 = 2 THEN NULL ELSE cast(300000000L * period_order as bigint) END"),
        }
    )
    return joins.derive_periods(marks, declared, ["entity_id"])


@query("derive_periods", "J16", PERIODS_SQL + " SELECT entity_id, section, period_id, start_ns, end_ns, source FROM p WHERE source IS NOT NULL")
def derive_periods(tb):
    return _periods(tb).select("entity_id", "section", "period_id", "start_ns", "end_ns", "source")


@query(
    "period_of_event",
    "J16",
    PERIODS_SQL
    + """ SELECT e.event_id, arg_min(p.period_id, p.period_order) AS period_id FROM tb_event e
          LEFT JOIN p ON p.entity_id = e.entity_id AND source IS NOT NULL AND e.t_rel_ns BETWEEN p.start_ns AND p.end_ns GROUP BY 1""",
)
def period_of_event(tb):
    return joins.period_of_event(tb.event, _periods(tb), ["entity_id"], "t_rel_ns").select("event_id", "period_id")


@query(
    "latest_at_or_before",
    "W24",
    """SELECT e.event_id, max(s.t_rel_ns) AS source_ns FROM tb_event e LEFT JOIN tb_signal s ON s.entity_id = e.entity_id AND s.event_type = 'view'
       AND s.t_rel_ns <= e.t_rel_ns AND e.t_rel_ns - s.t_rel_ns <= 72000000000000 GROUP BY 1""",
)
def latest_at_or_before(tb):
    return joins.latest_at_or_before(tb.event, tb.signal.filter("event_type = 'view'"), ["entity_id"], "t_rel_ns", 72_000_000_000_000, chunk=SIGNAL_CHUNK).select("event_id", "source_ns")


@query("alias_resolve", "J15", "SELECT player_id, coalesce(canonical_id, player_id) AS canonical_player FROM tb_alias_rows LEFT JOIN tb_alias_map ON player_id = alias_id")
def alias_resolve(tb):
    return joins.alias_resolve(tb.alias_rows, tb.alias_map, "player_id", "canonical_player").select("player_id", "canonical_player")


@query("unknown_games", "J13, U2", "SELECT DISTINCT contest_id FROM tb_plays WHERE contest_id NOT IN (SELECT contest_id FROM tb_schedule WHERE contest_id % 9 <> 4)")
def unknown_games(tb):
    return joins.missing_parents(tb.plays, tb.schedule.filter("contest_id % 9 <> 4"), {"contest_id": "contest_id"}, how="ids")


@query(
    "abbr_team_map",
    "J14",
    "SELECT lower(substr(n_name, 1, 2)) AS abbr, min(n_nationkey) AS team_id, min(n_nationkey) <> max(n_nationkey) AS is_conflict FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1",
)
def abbr_team_map(tb):
    nation = tb.table("nation")
    rows = tb.table("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.lower(F.substring("n_name", 1, 2)).alias("abbr"), F.col("n_nationkey").alias("team_id"))
    return joins.consistent_map(rows, "abbr", "team_id")


@query(
    "possession_context",
    "J19, S20",
    """WITH p AS (SELECT stream_id, CASE WHEN k % 20 = 0 THEN t_rel_ns ELSE t_rel_ns + 7 END AS t_rel_ns, CASE WHEN sample_index % 3 = 0 THEN NULL ELSE group_id END AS team_id, object_id AS player_id FROM tb_tracking),
       g AS (SELECT stream_id, t_rel_ns, count(*) AS n, count(DISTINCT coalesce(team_id, '-') || player_id) AS d, any_value(team_id) AS team_id, any_value(player_id) AS player_id,
                    bool_or(team_id IS NOT NULL) AS has FROM p GROUP BY 1, 2)
       SELECT b.stream_id, b.t_rel_ns, coalesce(d > 1, false) AS possession_conflict, n IS NOT NULL AS possession_present,
              CASE WHEN d = 1 THEN team_id END AS team_id, CASE WHEN d = 1 THEN player_id END AS player_id
       FROM tb_ball b LEFT JOIN g USING (stream_id, t_rel_ns)""",
)
def possession_context(tb):
    time = F.expr("CASE WHEN k % 20 = 0 THEN t_rel_ns ELSE t_rel_ns + 7 END").alias("t_rel_ns")  # most rows lie off the frames
    possession = tb.tracking.select("stream_id", time, F.expr("CASE WHEN sample_index % 3 = 0 THEN NULL ELSE group_id END").alias("team_id"), F.col("object_id").alias("player_id"))
    return joins.possession_context(tb.ball.select("stream_id", "t_rel_ns"), possession, ["stream_id", "t_rel_ns"], ["team_id", "player_id"])


COINCIDENCE_SQL = """
    WITH t AS (SELECT * REPLACE (frame % 240 AS frame), 'g' || frame // 240 AS contest_id FROM tb_tracking),
    po AS (SELECT contest_id, frame, CASE WHEN frame % 35 = 0 THEN NULL ELSE frame // 250 + 1 END AS period, CAST(frame * 40 AS VARCHAR) AS timestamp, CASE WHEN k % 6 <> 1 THEN object_id END AS player_id, x_m AS x, y_m AS y FROM t),
    tr AS (SELECT contest_id, frame, frame // 100 + 1 AS period, CAST(CASE WHEN frame % 8 = 0 THEN frame * 100 + 1 ELSE frame * 100 END AS VARCHAR) AS timestamp, CASE WHEN k % 5 <> 2 THEN object_id END AS player_id, x_m AS x, y_m AS y FROM t),
    sp AS (SELECT contest_id, frame * 2 // 5 AS frame, period, timestamp, player_id, x, y FROM po WHERE frame % 5 = 0),
    pf AS (SELECT contest_id, frame, min(period) AS period, min(timestamp) AS ts FROM sp GROUP BY 1, 2),
    tf AS (SELECT contest_id, frame, min(period) AS period, min(timestamp) AS ts FROM tr GROUP BY 1, 2),
    sh AS (SELECT contest_id, pf.frame, pf.period, pf.ts = tf.ts AS timestamp_match FROM pf JOIN tf USING (contest_id, frame) WHERE pf.period IS NOT NULL),
    pl AS (SELECT coalesce(a.contest_id, b.contest_id) AS contest_id, coalesce(a.frame, b.frame) AS frame, coalesce(a.player_id, b.player_id) AS player_id, a.frame IS NOT NULL AS in_pose, b.frame IS NOT NULL AS in_tracking,
                  sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS residual_m FROM sp a FULL JOIN tr b ON a.contest_id = b.contest_id AND a.frame = b.frame AND a.player_id = b.player_id),
    c AS (SELECT contest_id, sh.frame, sh.period, sh.timestamp_match, player_id, in_pose, in_tracking, residual_m FROM sh JOIN pl USING (contest_id, frame))"""


def _coincidence(tb):
    base = tb.tracking.withColumns({"contest_id": contest_of("frame"), "frame": F.expr("frame % 240")})
    pose = base.select(
        "contest_id", "frame", F.expr("CASE WHEN frame % 35 = 0 THEN NULL ELSE frame div 250 + 1 END").alias("period"), (F.col("frame") * 40).cast("string").alias("timestamp"), F.expr("CASE WHEN k % 6 <> 1 THEN object_id END").alias("player_id"), F.col("x_m").alias("x"), F.col("y_m").alias("y")
    )
    tracking = base.select(
        "contest_id", "frame", F.expr("frame div 100 + 1").alias("period"), F.expr("cast(CASE WHEN frame % 8 = 0 THEN frame * 100 + 1 ELSE frame * 100 END as string)").alias("timestamp"), F.expr("CASE WHEN k % 5 <> 2 THEN object_id END").alias("player_id"), F.col("x_m").alias("x"), F.col("y_m").alias("y")
    )
    return joins.coincidence(pose, tracking, keys=["contest_id"])


@query("pose_tracking_coincidence", "J18, U3", COINCIDENCE_SQL + " SELECT contest_id, frame, period, timestamp_match, player_id, in_pose, in_tracking, round(residual_m, 6) + 0.0 AS residual_m FROM c")
def pose_tracking_coincidence(tb):
    return rounded(_coincidence(tb), "residual_m")


@query(
    "coincidence_summary",
    "J18, L7",
    COINCIDENCE_SQL
    + """ SELECT contest_id, period, count(DISTINCT frame) AS frame_pairs, count(DISTINCT frame) FILTER (timestamp_match) AS timestamp_matches, count(*) FILTER (in_pose AND in_tracking) AS matched_players,
                 count(*) FILTER (in_pose AND NOT in_tracking) AS pose_only, count(*) FILTER (in_tracking AND NOT in_pose) AS tracking_only, count(residual_m) AS residuals,
                 round(avg(residual_m), 6) + 0.0 AS residual_mean, round(max(residual_m), 6) + 0.0 AS residual_max,
                 round(median(residual_m), 6) + 0.0 AS residual_median, round(quantile_cont(residual_m, 0.9), 6) + 0.0 AS residual_p90 FROM c GROUP BY 1, 2""",
)
def coincidence_summary(tb):
    rows = _coincidence(tb)
    both = F.col("in_pose") & F.col("in_tracking")
    counts = rows.groupBy("contest_id", "period").agg(
        F.countDistinct("frame").alias("frame_pairs"),
        F.countDistinct(F.when(F.col("timestamp_match"), F.col("frame"))).alias("timestamp_matches"),
        F.count_if(both).alias("matched_players"),
        F.count_if(F.col("in_pose") & ~F.col("in_tracking")).alias("pose_only"),
        F.count_if(~F.col("in_pose") & F.col("in_tracking")).alias("tracking_only"),
        F.count("residual_m").alias("residuals"),
        F.avg("residual_m").alias("residual_mean"),
        F.max("residual_m").alias("residual_max"),
    )
    spread = ranking.quantiles(rows, ["contest_id", "period"], "residual_m", {"residual_median": 0.5, "residual_p90": 0.9}).drop("valid_n")
    return rounded(counts.join(spread, ["contest_id", "period"], "left"), "residual_mean", "residual_max", "residual_median", "residual_p90")


@query(
    "set_to_video",
    "J30",
    """SELECT c_custkey AS set_no, o_orderkey AS video_no, coalesce(CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END, o_totalprice) AS load_kg
       FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1) ON c_custkey = o_custkey""",
)
def set_to_video(tb):
    video = tb.table("orders").groupBy(F.col("o_custkey").alias("set_no")).agg(F.min("o_orderkey").alias("video_no"), F.min_by("o_totalprice", "o_orderkey").alias("video_load"))
    sets = tb.table("customer").select(F.col("c_custkey").alias("set_no"), F.expr("CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END").alias("set_load"))
    return sets.join(video, "set_no", "left").select("set_no", "video_no", F.coalesce("set_load", "video_load").alias("load_kg"))


@query(
    "declared_participants",
    "J31",
    "SELECT sample_index, object_id FROM tb_tracking WHERE stream_id || object_id NOT IN (SELECT stream_id || object_id FROM tb_tracking WHERE k % 30 = 1 AND frame % 2 = 0)",
)
def declared_participants(tb):
    declared = tb.tracking.filter("k % 30 = 1 AND frame % 2 = 0")
    return joins.missing_parents(tb.tracking, declared, {"stream_id": "stream_id", "object_id": "object_id"}).select("sample_index", "object_id")


@query(
    "stream_authorities",
    "J32",
    """SELECT 'team' AS authority, CAST(s_suppkey AS VARCHAR) AS child, CAST(s_nationkey AS VARCHAR) AS missing FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 2)
       UNION ALL SELECT 'order', CAST(l_orderkey AS VARCHAR) || '-' || l_linenumber, CAST(l_partkey AS VARCHAR) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 3)""",
)
def stream_authorities(tb):
    teams = joins.missing_parents(tb.table("supplier"), tb.table("nation").filter("n_regionkey <> 2"), {"s_nationkey": "n_nationkey"})
    parts = joins.missing_parents(tb.table("lineitem"), tb.table("part").filter("p_size > 3"), {"l_partkey": "p_partkey"})
    text = lambda c: F.col(c).cast("string")
    return teams.select(F.lit("team").alias("authority"), text("s_suppkey").alias("child"), text("s_nationkey").alias("missing")).unionByName(
        parts.select(F.lit("order").alias("authority"), F.concat(text("l_orderkey"), F.lit("-"), text("l_linenumber")).alias("child"), text("l_partkey").alias("missing"))
    )


@query(
    "frames_with_players",
    "J26, P34",
    """SELECT c.contest_id, c.frame_idx, count(*) FILTER (t.object_type <> 'ball') AS players, min(t.object_id) FILTER (t.object_type <> 'ball') AS first_player,
              round(sum(t.x_m * 3.280839895013123) FILTER (t.object_type <> 'ball'), 4) + 0.0 AS x_total_ft, round(max(t.x_m * 3.280839895013123) FILTER (t.object_type = 'ball'), 4) + 0.0 AS ball_x_ft
       FROM tb_frame_clock c LEFT JOIN tb_frames t ON 'g' || t.frame // 240 = c.contest_id AND t.frame % 240 * 40000000 = c.canonical_time_ns GROUP BY 1, 2""",
)
def frames_with_players(tb):
    # All contests have the same times and players.
    tracking = tb.frames.withColumns({"contest_id": contest_of("frame"), "t_rel_ns": F.expr("frame % 240 * 40000000")})
    roster = tracking.select("contest_id", "object_id").distinct().withColumn("display_name", F.upper("object_id"))
    df = joins.frames_with_players(tb.frame_clock, tracking, roster, F.lit(1 / 0.3048), keys=["contest_id"])
    total = F.expr("aggregate(players, 0D, (a, p) -> a + p.x)")
    return df.select(
        "contest_id", "frame_idx", F.size("players").cast("bigint").alias("players"), F.get("players", F.lit(0))["object_id"].alias("first_player"), r6(total, 4).alias("x_total_ft"), r6(F.col("ball.x"), 4).alias("ball_x_ft")
    )
