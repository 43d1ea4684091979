"""Season aggregate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pacelane.operators import games, ranking, season
from pacelane.plans.registry import query, r6, rounded

METRICS = ["balance", "avg_price", "max_price"]
TALL = "SELECT subject_id, team_id, position_group, count_match, m.metric, CASE m.metric WHEN 'balance' THEN balance WHEN 'avg_price' THEN avg_price ELSE max_price END AS value FROM tb_season, (VALUES ('balance'), ('avg_price'), ('max_price')) m(metric)"


@query(
    "rank_within",
    "W12",
    f"""WITH t AS ({TALL}),
       r AS (SELECT *, CASE WHEN value IS NOT NULL THEN rank() OVER (PARTITION BY team_id, metric ORDER BY value DESC NULLS LAST) END AS rk,
                    count(value) OVER (PARTITION BY team_id, metric) AS valid_n, count(*) OVER (PARTITION BY team_id, metric) AS population_n FROM t),
       g AS (SELECT team_id, metric, min(value) AS mn, max(value) AS mx, median(value) AS md FROM t GROUP BY 1, 2),
       c AS (SELECT a.subject_id, a.metric, count(*) AS at_or_below FROM t a JOIN t b ON a.team_id = b.team_id AND a.metric = b.metric AND b.value <= a.value GROUP BY 1, 2)
       SELECT r.subject_id, r.team_id, r.metric, r.value, population_n, valid_n, rk AS rank, round_even(100.0::DOUBLE * at_or_below / valid_n, 1) + 0.0 AS percentile,
              round(mn, 6) + 0.0 AS minimum, round(md, 6) + 0.0 AS median, round(mx, 6) + 0.0 AS maximum
       FROM r JOIN g USING (team_id, metric) LEFT JOIN c USING (subject_id, metric)""",
)
def rank_within(tb):
    rows = season.metric_rows(tb.season, ["subject_id", "team_id"], METRICS)
    return rounded(ranking.rank_within(rows, ["team_id", "metric"], "value"), "minimum", "median", "maximum")


@query(
    "rank_edition",
    "W12 (one population)",
    """SELECT c_custkey AS subject_id, rank() OVER (ORDER BY c_nationkey DESC) AS rank, round_even(100.0::DOUBLE * count(*) OVER (ORDER BY c_nationkey RANGE UNBOUNDED PRECEDING) / count(*) OVER (), 1) + 0.0 AS percentile FROM customer""",
)
def rank_edition(tb):
    rows = tb.table("customer").select(F.col("c_custkey").alias("subject_id"), F.lit("all").alias("edition"), F.col("c_nationkey").cast("double").alias("value"))
    return ranking.rank_within(rows, ["edition"], "value").select("subject_id", "rank", "percentile")


def _profile_sql(scope: str, least: int) -> str:
    on = {"edition": "", "team": " AND b.team_id = a.team_id", "position": " AND b.position_group = a.position_group"}[scope]
    return f"""WITH t AS ({TALL}), p AS (SELECT * FROM t WHERE count_match >= {least}),
       c AS (SELECT a.subject_id, a.metric, any_value(a.value) AS value, any_value(a.count_match) >= {least} AS in_population, count(b.subject_id) AS population_n, count(b.value) AS valid_n,
                    count(*) FILTER (b.value > a.value) AS above, min(b.value) AS mn, max(b.value) AS mx, median(b.value) AS md
             FROM t a LEFT JOIN p b ON a.metric = b.metric{on} GROUP BY 1, 2)
       SELECT subject_id, metric, value, in_population, population_n, valid_n, CASE WHEN value IS NOT NULL AND valid_n > 0 THEN above + 1 END AS rank,
              CASE WHEN value IS NOT NULL AND valid_n > 0 THEN round_even(100.0::DOUBLE * (valid_n - above) / valid_n, 1) + 0.0 END AS percentile,
              round(mn, 6) + 0.0 AS minimum, round(md, 6) + 0.0 AS median, round(mx, 6) + 0.0 AS maximum FROM c"""


def _profile(tb, scope):
    df = season.profile(tb.season, METRICS, scope=scope, min_matches=9).drop("team_id", "position_group")
    return rounded(df, "minimum", "median", "maximum")


@query("profile_team", "W13", _profile_sql("team", 9))
def profile_team(tb):
    return _profile(tb, "team")


@query("profile_position", "W13", _profile_sql("position", 9))
def profile_position(tb):
    return _profile(tb, "position")


@query("profile_edition", "W13", _profile_sql("edition", 9))
def profile_edition(tb):
    return _profile(tb, "edition")


@query("season_filter", "P25", "SELECT subject_id, team_id FROM tb_season WHERE position_group = 'MACHINERY' AND count_match >= 10 AND team_id = 'NATION_7' OR (position_group = 'MACHINERY' AND subject_id IN (3, 4, 5, 9, 27))")
def season_filter(tb):
    teams = season.season_filter(tb.season, position_group="MACHINERY", min_matches=10, team_id="NATION_7")
    few = season.season_filter(tb.season, position_group="MACHINERY", subject_ids=[3, 4, 5, 9, 27])
    return teams.unionByName(few).select("subject_id", "team_id").distinct()


@query(
    "population_summary",
    "G9",
    "SELECT team_id, position_group, count(*) AS rows, count(DISTINCT subject_id) AS subjects, CAST(grouping_id(team_id, position_group) AS BIGINT) AS level FROM tb_season GROUP BY GROUPING SETS ((team_id), (position_group), ())",
)
def population_summary(tb):
    return season.population_summary(tb.season)


@query("season_page", "L1", "SELECT subject_id, player_name, team_id, position_group, balance FROM tb_season WHERE count_match >= 8 ORDER BY team_id, player_name, position_group, subject_id LIMIT 64 OFFSET 32")
def season_page(tb):
    rows = season.season_filter(tb.season, min_matches=8).select("subject_id", "player_name", "team_id", "position_group", "balance")
    return games.page(rows, [F.col(c).asc() for c in ("team_id", "player_name", "position_group", "subject_id")], limit=64, offset=32)


@query(
    "merge_alias_rows",
    "G14, J15",
    """WITH r AS (SELECT coalesce(canonical_id, player_id) AS cp, tb_alias_rows.* FROM tb_alias_rows LEFT JOIN tb_alias_map ON player_id = alias_id WHERE lower(team_name) <> 'total'),
       f AS (SELECT *, CASE WHEN attempts IS NULL THEN fg_percentage IS NULL WHEN fg_percentage IS NULL THEN attempts = 0 ELSE attempts = 0 AND fg_percentage = 0 END AS skip FROM r),
       g AS (SELECT *, NOT skip AND (attempts IS NULL OR attempts <= 0 OR fg_percentage IS NULL) AS broken FROM f)
       SELECT cp AS canonical_player, team_id, count(*) AS source_rows, string_agg(player_id, ',' ORDER BY player_id) AS provider_player_ids, round(CAST(sum(games_played) AS DOUBLE), 6) + 0.0 AS games_played,
              round(sum(attempts), 4) + 0.0 AS attempts,
              round(CASE WHEN count(*) = 1 THEN max(fg_percentage) WHEN bool_or(broken) THEN NULL ELSE sum(fg_percentage * attempts) FILTER (NOT skip) / sum(attempts) FILTER (NOT skip) END, 6) + 0.0 AS fg_percentage
       FROM g GROUP BY 1, 2""",
)
def merge_alias_rows(tb):
    df = season.merge_alias_rows(tb.alias_rows, tb.alias_map, ["games_played", "attempts", "fg_percentage"])
    return rounded(rounded(df, "games_played", "fg_percentage"), "attempts", digits=4)


COLUMNS = """CASE p_partkey % 6 WHEN 0 THEN 'hsr_distance_full_tip' WHEN 1 THEN 'psv99' WHEN 2 THEN 'minutes_full_otip' WHEN 3 THEN 'sprint_count_full_all' WHEN 4 THEN 'hsr_distance_full_all' ELSE concat('weird_', cast(p_size as string)) END"""


@query(
    "season_metric_spec",
    "P24",
    f"""WITH c AS (SELECT DISTINCT {COLUMNS.replace('string', 'VARCHAR')} AS col FROM part)
       SELECT col AS "column", CASE col WHEN 'hsr_distance_full_tip' THEN 'HSR distance · TIP' WHEN 'psv99' THEN 'PSV-99' WHEN 'minutes_full_otip' THEN 'Minutes · OTIP' WHEN 'sprint_count_full_all' THEN 'Sprint efforts' WHEN 'hsr_distance_full_all' THEN 'HSR distance' END AS label,
              CASE WHEN col = 'psv99' THEN 'Peak speed' WHEN col LIKE 'minutes%' THEN 'Exposure' WHEN col NOT LIKE 'weird%' THEN 'Volume' END AS metric_group,
              CASE WHEN col = 'psv99' THEN 'km/h' WHEN col LIKE 'minutes%' THEN 'min' WHEN col LIKE 'hsr%' THEN 'm' WHEN col LIKE 'sprint%' THEN 'count' END AS unit,
              CASE WHEN col LIKE '%_full_%' THEN regexp_extract(col, '_full_(.*)$', 1) END AS split, CASE WHEN col LIKE '%_full_%' THEN regexp_extract(col, '^(.*)_full_', 1) END AS base, col NOT LIKE 'weird%' AS known FROM c""",
)
def season_metric_spec(tb):
    return season.season_metric_spec(tb.table("part").select(F.expr(COLUMNS).alias("column")).distinct(), "physical")


RUNS = """CASE p_partkey % 5 WHEN 0 THEN 'behindrun_count_dangerous_received_p30tip' WHEN 1 THEN 'overlaprun_count_p30tip' WHEN 2 THEN 'supportrun_avgdistance' WHEN 3 THEN 'minutes_tip' ELSE concat('crossreceiverrun_count_q', cast(p_size as string), '_p30tip') END"""


@query(
    "season_run_spec",
    "P24",
    f"""WITH c AS (SELECT DISTINCT {RUNS.replace('string', 'VARCHAR')} AS col FROM part)
       SELECT col AS "column", CASE WHEN col LIKE 'behind%' THEN 'Runs in behind · Dangerous · received' WHEN col LIKE 'overlap%' THEN 'Overlap' WHEN col LIKE 'support%' THEN 'Support · mean distance' WHEN col = 'minutes_tip' THEN 'TIP minutes per match' END AS label,
              CASE WHEN col LIKE 'behind%' THEN 'Threat' WHEN col LIKE 'overlap%' THEN 'Volume' WHEN col LIKE 'support%' THEN 'Distance' WHEN col = 'minutes_tip' THEN 'Exposure' END AS metric_group,
              CASE WHEN col LIKE 'behind%' OR col LIKE 'overlap%' THEN 'count' WHEN col LIKE 'support%' THEN 'm' WHEN col = 'minutes_tip' THEN 'min' END AS unit,
              CASE WHEN col LIKE 'behind%' THEN 'dangerous_received' WHEN col LIKE 'overlap%' THEN 'runs' WHEN col LIKE 'support%' THEN 'avgdistance' END AS split,
              CASE WHEN col LIKE 'behind%' THEN 'behindrun' WHEN col LIKE 'overlap%' THEN 'overlaprun' WHEN col LIKE 'support%' THEN 'supportrun' END AS base, col NOT LIKE 'cross%' AS known FROM c""",
)
def season_run_spec(tb):
    return season.season_metric_spec(tb.table("part").select(F.expr(RUNS).alias("column")).distinct(), "obr")


@query(
    "split_pairs",
    "J34",
    f"""WITH c AS (SELECT DISTINCT {COLUMNS.replace('string', 'VARCHAR')} AS col FROM part)
       SELECT 'hsr_distance' AS base, max(col) FILTER (col = 'hsr_distance_full_all') AS all_column, max(col) FILTER (col = 'hsr_distance_full_tip') AS tip_column, CAST(NULL AS VARCHAR) AS otip_column FROM c""",
)
def split_pairs(tb):
    return season.split_pairs(season.season_metric_spec(tb.table("part").select(F.expr(COLUMNS).alias("column")).distinct(), "physical"))


@query("season_ratio", "G14 (weights)", "SELECT position_group, round(sum(balance * count_match) / sum(count_match), 4) + 0.0 AS weighted_balance FROM tb_season WHERE count_match > 0 GROUP BY 1")
def season_ratio(tb):
    rows = tb.season.filter("count_match > 0")
    return rows.groupBy("position_group").agg(r6(F.sum(F.col("balance") * F.col("count_match")) / F.sum("count_match"), 4).alias("weighted_balance"))
