"""League release tags and asset names as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Leagues with their sport and tag prefixes, in resolution order.
LEAGUES = [
    ("nba", "basketball", ("espn_nba_", "nba_")),
    ("wnba", "basketball", ("espn_wnba_", "wnba_")),
    ("mbb", "basketball", ("espn_mbb_", "ncaa_mbb_", "mbb_")),
    ("wbb", "basketball", ("espn_wbb_", "ncaa_wbb_", "espn_womens_college_basketball_", "wbb_")),
    ("nhl", "ice_hockey", ("espn_nhl_", "nhl_")),
    ("pwhl", "ice_hockey", ("pwhl_",)),
    ("phf", "ice_hockey", ("phf_",)),
    ("nfl", "american_football", ("espn_nfl_", "nfl_")),
    ("cfb", "american_football", ("espn_cfb_", "cfb_", "ncaa_mfb_")),
    ("mlb", "baseball", ("espn_mlb_", "mlb_")),
    ("ncaa_baseball", "baseball", ("ncaa_baseball_",)),
]
# Family patterns in resolution order with their grain.
FAMILIES = [
    ("play_by_play", r"(^|_)pbp(_lite|_full)?$", "PLAY_BY_PLAY"),
    ("schedule", r"(^|_)(schedules?|games)$", "GAME_SUMMARY"),
    ("game_info", r"(^|_)(game_info|linescore)$", "GAME_SUMMARY"),
    ("player_game", r"(^|_)(player|skater|goalie)_box(scores?)?$|(^|_)player_game_logs$", "PLAYER_GAME"),
    ("team_game", r"(^|_)team_box(scores?)?$", "TEAM_GAME"),
    ("player_season", r"(^|_)player_season_stats$", "PLAYER_SEASON"),
    ("team_season", r"(^|_)team_season_stats$", "TEAM_SEASON"),
    ("shots", r"(^|_)shots$", "EVENT_SERIES"),
    ("roster", r"(^|_)(game_|team_)?rosters$", None),
]
# Extensions of season files.
EXTENSIONS = (".csv.gz", ".csv", ".parquet", ".rds")
SPLIT_YEAR_LEAGUES = ("nba", "nhl", "mbb", "wbb", "pwhl")


def classify_family(tag: Column) -> dict[str, Column]:
    """League, sport, family kind and grain of a release tag; the first rule that fits wins."""
    league, sport, stem = F.lit(None).cast("string"), F.lit(None).cast("string"), tag
    for code, of, prefixes in reversed(LEAGUES):
        for prefix in reversed(prefixes):
            hit = tag.startswith(prefix)
            league, sport = F.when(hit, code).otherwise(league), F.when(hit, of).otherwise(sport)
            stem = F.when(hit, F.substr(tag, F.lit(len(prefix) + 1))).otherwise(stem)
    kind, grain = F.lit("unmapped"), F.lit(None).cast("string")
    for name, pattern, of in reversed(FAMILIES):
        hit = stem.rlike(pattern)
        kind, grain = F.when(hit, name).otherwise(kind), F.when(hit, F.lit(of)).otherwise(grain)
    return {"league_id": league, "sport_id": sport, "family_kind": kind, "grain": grain, "mapped": league.isNotNull() & grain.isNotNull()}


def asset_season(name: Column) -> Column:
    """Season year of an asset name; a range like 2025-26 names the year it ends in.

    A season file is called ``words_year.ext``, ``words_year_lite.ext`` or ``words_year-yy.ext``; words are set apart by
    ``_`` or ``-``.
    """
    stem = F.lit(None).cast("string")
    for extension in EXTENSIONS:
        stem = F.coalesce(stem, F.when(name.endswith(extension), F.left(name, F.length(name) - len(extension))))
    words = F.split(F.translate(stem, "-", "_"), "_")
    word = lambda back: F.try_element_at(words, F.lit(-back))
    year = lambda text: F.when((F.length(text) == 4) & text.try_cast("int").between(1900, 2099), text.try_cast("int"))
    light = word(1) == "lite"
    end = F.when((F.length(word(1)) == 2) & word(1).try_cast("int").isNotNull() & (F.left(F.right(stem, F.lit(3)), F.lit(1)) == "-"), year(word(2)) + 1)
    return F.when(light, year(word(2))).otherwise(F.coalesce(year(word(1)), end))


def edition_label(league: Column, season: Column) -> Column:
    split = F.concat((season - 1).cast("string"), F.lit("-"), F.substring(season.cast("string"), -2, 2))
    return F.when(league.isin(*SPLIT_YEAR_LEAGUES), split).otherwise(season.cast("string"))
