"""Play-by-play leagues: clocks, periods, dimensions, scores and game reads."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pacelane.operators.clean import canonical_id, crosswalk_id

NS = 1_000_000_000


def _ns(seconds: Column) -> Column:
    return seconds.cast("bigint") * F.lit(NS).cast("bigint")


@dataclass(frozen=True)
class PeriodRule:
    """Regulation and overtime lengths of a league and the direction of its clock."""

    regulation_periods: int
    regulation_s: int
    overtime_s: int
    playoff_overtime_s: int
    counts_down: bool
    regulation_kind: str


# Fixed values of the two leagues.
NBA = PeriodRule(4, 720, 300, 300, True, "quarter")
NHL = PeriodRule(3, 1200, 300, 1200, False, "period")


def period_length_s(rule: PeriodRule, period: Column, postseason: Column) -> Column:
    return F.when(period <= rule.regulation_periods, rule.regulation_s).otherwise(F.when(postseason, rule.playoff_overtime_s).otherwise(rule.overtime_s)).cast("bigint")


def period_origin_ns(rule: PeriodRule, period: Column, postseason: Column) -> Column:
    """Start of a period on the contest axis: all regulation before it, then overtimes."""
    extra = F.greatest(period - 1 - rule.regulation_periods, F.lit(0))
    overtime = F.when(postseason, rule.playoff_overtime_s).otherwise(rule.overtime_s)
    return _ns(F.least(period - 1, F.lit(rule.regulation_periods)) * rule.regulation_s + extra * overtime)


def game_clock_ns(rule: PeriodRule, period: Column, clock_s: Column, postseason: Column, shootout: Column | None = None) -> Column:
    """Contest time of a game clock; NULL outside the period and in a shootout."""
    length = period_length_s(rule, period, postseason)
    elapsed = length - clock_s if rule.counts_down else clock_s
    inside = (clock_s >= 0) & (clock_s <= length)
    if shootout is not None:
        inside = inside & ~F.coalesce(shootout, F.lit(False))
    return F.when(inside, period_origin_ns(rule, period, postseason) + F.rint(elapsed * NS).cast("bigint"))


def contest_periods(plays: DataFrame, rule: PeriodRule, label: str = "label") -> DataFrame:
    """Periods seen in the plays with kind and span; a shootout is untimed."""
    period, post = F.col("period_number"), F.col("postseason")
    seen = plays.groupBy("contest_id", "period_number").agg(F.max(label).alias("label"), F.max("postseason").alias("postseason"))
    shootout = F.coalesce(F.lower("label").contains("shootout"), F.lit(False))
    start = period_origin_ns(rule, period, post)
    kind = F.when(period <= rule.regulation_periods, rule.regulation_kind).when(shootout, "other").otherwise("overtime")
    return seen.select(
        F.concat_ws(":", F.col("contest_id").cast("string"), F.lit("period"), period.cast("string")).alias("contest_period_id"),
        "contest_id",
        "period_number",
        kind.alias("kind"),
        "label",
        F.when(~shootout, start).alias("start_ns"),
        F.when(~shootout, start + _ns(period_length_s(rule, period, post))).alias("end_ns"),
    )


def role_of_side(schedule: DataFrame) -> DataFrame:
    """Two rows per game: side, order and the score once the game is completed."""
    side = lambda name, order, score: F.struct(
        F.lit(name).alias("team_id"),
        F.when(F.col("neutral_site"), "neutral").otherwise(name).alias("side"),
        F.lit(order).alias("side_order"),
        F.when(F.col("completed"), F.col(score)).alias("score"),
    )
    return schedule.select("contest_id", F.inline(F.array(side("home", 0, "home_final"), side("away", 1, "away_final"))))


def score_reconciliation(plays: DataFrame, schedule: DataFrame) -> DataFrame:
    """Last play score against the final score of every completed game that has plays.

    A shootout adds one goal to a tied score without a play.
    """
    last = plays.groupBy("contest_id").agg(F.max_by(F.struct("home_score", "away_score"), F.struct("period_number", "sequence_index")).alias("last"))
    joined = schedule.filter("completed").join(last, "contest_id")
    same = (F.col("last.home_score") == F.col("home_final")) & (F.col("last.away_score") == F.col("away_final"))
    decided = (
        F.col("shootout")
        & (F.col("last.home_score") == F.col("last.away_score"))
        & (F.abs(F.col("home_final") - F.col("away_final")) == 1)
        & (F.least("home_final", "away_final") == F.col("last.home_score"))
    )
    verdict = F.when(same, "match").when(F.coalesce(decided, F.lit(False)), "shootout_decided").otherwise("discrepancy")
    return joined.select("contest_id", verdict.alias("verdict"), F.col("last.home_score").alias("pbp_home"), F.col("last.away_score").alias("pbp_away"), "home_final", "away_final")


def score_summary(reconciled: DataFrame) -> DataFrame:
    verdict = F.col("verdict")
    return reconciled.agg(
        F.count(F.lit(1)).alias("completed_games_with_pbp"),
        F.count_if(verdict == "match").alias("final_score_matches"),
        F.count_if(verdict == "shootout_decided").alias("shootout_decided"),
        F.count_if(verdict == "discrepancy").alias("provider_score_discrepancies"),
    )


def with_ids(rows: DataFrame, contests: DataFrame, teams: DataFrame, game: str, team: str) -> DataFrame:
    """Rows of known games with contest and team ids in front."""
    return rows.join(contests, game).join(teams, team, "left").select("canonical_contest_id", "canonical_team_id", *rows.columns)


def semantic_dims(schedule: DataFrame, namespace: str, authority: str) -> DataFrame:
    """Team, contest and contest-team rows plus their crosswalk, from one pass over the schedule."""
    game = lambda kind, provider: F.struct(
        F.lit(kind).alias("entity_kind"),
        provider.cast("string").alias("provider_entity_id"),
        canonical_id(namespace, kind, provider).alias("canonical_entity_id"),
        crosswalk_id(namespace, kind, provider).alias("crosswalk_id"),
    )
    items = F.array(game("contest", F.col("game_id")), game("team", F.col("home_id")), game("team", F.col("away_id")), game("edition", F.col("season")))
    return schedule.select(F.inline(items)).distinct().withColumn("source_authority", F.lit(authority))


def page(df: DataFrame, order: Sequence[Column], *, limit: int, offset: int = 0) -> DataFrame:
    """One page in a stated total order; the sort is a top-k, not a full sort."""
    return df.orderBy(*order).offset(offset).limit(limit)
