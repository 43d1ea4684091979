"""Play-by-play league queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pacelane.operators import games
from pacelane.plans.registry import query


def _clocked(tb):
    return tb.plays.withColumns({"postseason": F.expr("contest_id % 4 = 0"), "shootout": F.expr("contest_id % 7 = 0 AND period_number = 5")})


def _clock_sql(regulation: int, length: int, ot: int, playoff: int, elapsed: str) -> str:
    over = f"CASE WHEN contest_id % 4 = 0 THEN {playoff} ELSE {ot} END"
    span = f"CASE WHEN period_number <= {regulation} THEN {length} ELSE {over} END"
    origin = f"(least(period_number - 1, {regulation}) * {length} + greatest(period_number - 1 - {regulation}, 0) * ({over}))"
    return f"CASE WHEN clock_s >= 0 AND clock_s <= {span} THEN CAST({origin} * 1000000000 + round_even(({elapsed.replace('LEN', span)}) * 1e9, 0) AS BIGINT) END"


@query(
    "game_clock_ns",
    "P4",
    f"""SELECT contest_id, sequence_index, {_clock_sql(4, 720, 300, 300, '(LEN) - clock_s')} AS nba_ns,
               CASE WHEN contest_id % 7 = 0 AND period_number = 5 THEN NULL ELSE {_clock_sql(3, 1200, 300, 1200, 'clock_s')} END AS nhl_ns FROM tb_plays""",
)
def game_clock_ns(tb):
    period, clock, post = F.col("period_number"), F.col("clock_s"), F.col("postseason")
    return _clocked(tb).select(
        "contest_id", "sequence_index", games.game_clock_ns(games.NBA, period, clock, post).alias("nba_ns"), games.game_clock_ns(games.NHL, period, clock, post, F.col("shootout")).alias("nhl_ns")
    )


@query(
    "contest_periods",
    "P35",
    """WITH p AS (SELECT contest_id, period_number, max(CASE WHEN contest_id % 7 = 0 AND period_number = 5 THEN 'Shootout' ELSE 'P' || period_number END) AS label, contest_id % 4 = 0 AS post FROM tb_plays GROUP BY ALL),
       q AS (SELECT *, CAST(least(period_number - 1, 3) * 1200 + greatest(period_number - 4, 0) * CASE WHEN post THEN 1200 ELSE 300 END AS BIGINT) * 1000000000 AS s, CASE WHEN period_number <= 3 THEN 1200 WHEN post THEN 1200 ELSE 300 END AS d FROM p)
       SELECT contest_id || ':period:' || period_number AS contest_period_id, contest_id, period_number, CASE WHEN period_number <= 3 THEN 'period' WHEN label = 'Shootout' THEN 'other' ELSE 'overtime' END AS kind, label,
              CASE WHEN label <> 'Shootout' THEN CAST(s AS BIGINT) END AS start_ns, CASE WHEN label <> 'Shootout' THEN CAST(s + CAST(d AS BIGINT) * 1000000000 AS BIGINT) END AS end_ns FROM q""",
)
def contest_periods(tb):
    plays = _clocked(tb).withColumn("label", F.expr("CASE WHEN shootout THEN 'Shootout' ELSE concat('P', cast(period_number as string)) END"))
    return games.contest_periods(plays, games.NHL)


@query(
    "role_of_side",
    "P33",
    """SELECT contest_id, s.team_id, CASE WHEN neutral_site THEN 'neutral' ELSE s.team_id END AS side, s.o AS side_order, CASE WHEN completed THEN CASE s.team_id WHEN 'home' THEN home_final ELSE away_final END END AS score
       FROM tb_schedule, (VALUES ('home', 0), ('away', 1)) s(team_id, o)""",
)
def role_of_side(tb):
    return games.role_of_side(tb.schedule)


SCORE_SQL = """
    WITH l AS (SELECT contest_id, arg_max(home_score, sequence_index) AS h, arg_max(away_score, sequence_index) AS a FROM tb_plays GROUP BY 1),
    v AS (SELECT s.contest_id, CASE WHEN h = home_final AND a = away_final THEN 'match' WHEN shootout AND h = a AND abs(home_final - away_final) = 1 AND least(home_final, away_final) = h THEN 'shootout_decided' ELSE 'discrepancy' END AS verdict,
                 h AS pbp_home, a AS pbp_away, home_final, away_final FROM tb_schedule s JOIN l USING (contest_id) WHERE completed)"""


@query("score_reconciliation", "G15", SCORE_SQL + " SELECT * FROM v")
def score_reconciliation(tb):
    return games.score_reconciliation(tb.plays, tb.schedule)


@query(
    "score_summary",
    "G15",
    SCORE_SQL
    + """ SELECT count(*) AS completed_games_with_pbp, count(*) FILTER (verdict = 'match') AS final_score_matches, count(*) FILTER (verdict = 'shootout_decided') AS shootout_decided,
                 count(*) FILTER (verdict = 'discrepancy') AS provider_score_discrepancies FROM v""",
)
def score_summary(tb):
    return games.score_summary(games.score_reconciliation(tb.plays, tb.schedule))


@query("discrepancy_examples", "L7, G15", SCORE_SQL + " SELECT contest_id, pbp_home, pbp_away, home_final, away_final FROM v WHERE verdict = 'discrepancy' ORDER BY contest_id LIMIT 20")
def discrepancy_examples(tb):
    wrong = games.score_reconciliation(tb.plays, tb.schedule).filter("verdict = 'discrepancy'").drop("verdict")
    return games.page(wrong, [F.col("contest_id").asc()], limit=20)


@query("period_event_counts", "G11", "SELECT contest_id, period_number, count(*) AS events FROM tb_plays GROUP BY 1, 2")
def period_event_counts(tb):
    return tb.plays.groupBy("contest_id", "period_number").agg(F.count(F.lit(1)).alias("events"))


@query(
    "period_ranges",
    "G10",
    """SELECT contest_id, period_number, CASE WHEN period_number <= 4 THEN 'Q' || period_number ELSE 'OT' || (period_number - 4) END AS label, min(frame_idx) AS first_frame,
              coalesce(min(frame_idx) FILTER (player_count > 0 OR ball_present), min(frame_idx)) AS first_active_frame, max(frame_idx) AS last_frame, count(*) AS frame_count,
              count(*) FILTER (player_count = 0 AND NOT ball_present) AS dead_time_frames FROM tb_frame_clock GROUP BY 1, 2""",
)
def period_ranges(tb):
    active = (F.col("player_count") > 0) | F.col("ball_present")
    grouped = tb.frame_clock.groupBy("contest_id", "period_number").agg(
        F.min("frame_idx").alias("first_frame"),
        F.coalesce(F.min(F.when(active, F.col("frame_idx"))), F.min("frame_idx")).alias("first_active_frame"),
        F.max("frame_idx").alias("last_frame"),
        F.count(F.lit(1)).alias("frame_count"),
        F.count_if(~active).alias("dead_time_frames"),
    )
    return grouped.withColumn("label", F.expr("CASE WHEN period_number <= 4 THEN concat('Q', cast(period_number as string)) ELSE concat('OT', cast(period_number - 4 as string)) END"))


@query("plays_page", "L2", "SELECT contest_id, period_number, sequence_index, points FROM tb_plays WHERE team_id IS NOT NULL ORDER BY contest_id, period_number, sequence_index LIMIT 50 OFFSET 25")
def plays_page(tb):
    rows = tb.plays.filter("team_id IS NOT NULL").select("contest_id", "period_number", "sequence_index", "points")
    return games.page(rows, [F.col(c).asc() for c in ("contest_id", "period_number", "sequence_index")], limit=50, offset=25)


@query("box_score", "L3, G15", "SELECT contest_id, coalesce(team_id, '-') AS team_id, count(*) AS plays, CAST(sum(points) AS BIGINT) AS points FROM tb_plays GROUP BY 1, 2 ORDER BY ALL")
def box_score(tb):
    box = tb.plays.groupBy("contest_id", F.coalesce("team_id", F.lit("-")).alias("team_id")).agg(F.count(F.lit(1)).alias("plays"), F.sum("points").alias("points"))
    return box.orderBy(*box.columns)


@query("events_nulls_last", "L4", "SELECT contest_id, sequence_index, clock_s FROM (SELECT *, CASE WHEN points > 0 THEN clock_s END AS c FROM tb_plays) ORDER BY c NULLS LAST, contest_id, sequence_index LIMIT 100")
def events_nulls_last(tb):
    order = [F.asc_nulls_last(F.when(F.col("points") > 0, F.col("clock_s"))), F.col("contest_id").asc(), F.col("sequence_index").asc()]
    return games.page(tb.plays.select("contest_id", "sequence_index", "clock_s", "points"), order, limit=100).drop("points")


@query(
    "with_ids",
    "P11",
    """SELECT 'contest-' || substr(md5('bed:contest:' || p.contest_id), 1, 24) AS canonical_contest_id, CASE WHEN p.team_id = 'home' THEN 'team-' || substr(md5('bed:team:home'), 1, 24) END AS canonical_team_id,
              p.contest_id, p.team_id, p.sequence_index FROM tb_plays p JOIN tb_schedule s ON s.contest_id = p.contest_id WHERE s.completed""",
)
def with_ids(tb):
    from pacelane.operators.clean import canonical_id

    contests = tb.schedule.filter("completed").select("contest_id", canonical_id("bed", "contest", F.col("contest_id")).alias("canonical_contest_id"))
    teams = tb.plays.filter("team_id = 'home'").select("team_id").distinct().withColumn("canonical_team_id", canonical_id("bed", "team", F.col("team_id")))
    return games.with_ids(tb.plays.select("contest_id", "team_id", "sequence_index"), contests, teams, "contest_id", "team_id")


@query(
    "semantic_dims",
    "P36",
    """WITH g AS (SELECT o_orderkey AS game_id, o_custkey % 30 AS home_id, (o_custkey + 7) % 30 AS away_id, year(o_orderdate) AS season FROM orders),
       e AS (SELECT 'contest' AS entity_kind, CAST(game_id AS VARCHAR) AS provider_entity_id FROM g UNION SELECT 'team', CAST(home_id AS VARCHAR) FROM g UNION SELECT 'team', CAST(away_id AS VARCHAR) FROM g UNION SELECT 'edition', CAST(season AS VARCHAR) FROM g)
       SELECT entity_kind, provider_entity_id, entity_kind || '-' || substr(md5('bed:' || entity_kind || ':' || provider_entity_id), 1, 24) AS canonical_entity_id,
              'xw-' || md5('bed:' || entity_kind || ':' || provider_entity_id) AS crosswalk_id, 'driver' AS source_authority FROM e""",
)
def semantic_dims(tb):
    schedule = tb.table("orders").select(F.col("o_orderkey").alias("game_id"), (F.col("o_custkey") % 30).alias("home_id"), ((F.col("o_custkey") + 7) % 30).alias("away_id"), F.year("o_orderdate").alias("season"))
    return games.semantic_dims(schedule, "bed", "driver")


@query("contests_with_team", "J23", "SELECT contest_id FROM tb_schedule s WHERE EXISTS (SELECT 1 FROM tb_plays p WHERE p.contest_id = s.contest_id AND p.team_id = 'away' AND p.points = 3)")
def contests_with_team(tb):
    return tb.schedule.select("contest_id").join(tb.plays.filter("team_id = 'away' AND points = 3").select("contest_id"), "contest_id", "left_semi")
