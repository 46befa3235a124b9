"""The matchup matrix: home-minus-away differences per game."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playmetrics.functions.scalars import (
    adjusted_temp,
    adjusted_wind,
    categorize_environment,
    classify_ats_result,
    cover_margin,
    fill,
    game_winner,
    spread_to_win_prob,
    total_result,
    weather_impact_score,
)
from playmetrics.operators.relational import prefix_columns
from playmetrics.operators.sizing import attach, settle
from playmetrics.plans.players import rating_features
from playmetrics.plans.teams import team_season_profiles
from playmetrics.sources.tables import final_games

# Stand-ins for missing ratings, postseason and market figures.
MISSING = {
    "playoff_off_epa": 0,
    "qb_ovr": 80,
    "avg_starter_ovr": 80,
    "max_ovr": 90,
    "spread_line": 0,
    "total_line": 47,
}

# Feature and the team-season column it compares.
DIFFERENCES = {
    "off_epa_diff": "off_epa",
    "def_epa_diff": "def_epa_allowed",
    "pass_epa_diff": "pass_epa",
    "rush_epa_diff": "rush_epa",
    "success_rate_diff": "off_success_rate",
    "explosive_rate_diff": "explosive_rate",
    "redzone_epa_diff": "redzone_epa",
    "third_down_epa_diff": "third_down_epa",
    "turnover_diff": "turnover_diff",
    "playoff_epa_diff": "playoff_off_epa",
    "qb_ovr_diff": "qb_ovr",
    "avg_ovr_diff": "avg_starter_ovr",
    "max_ovr_diff": "max_ovr",
}


def clean_weather(games: DataFrame) -> DataFrame:
    """Add the environment, the temperature and wind as felt, and the weather's impact.

    Only a dome counts as climate-controlled: a closed roof is indoors but keeps its weather.
    """
    return games.withColumns(
        {
            "environment": categorize_environment("roof"),
            "temp_adjusted": adjusted_temp(),
            "wind_adjusted": adjusted_wind(),
            "weather_impact_score": weather_impact_score(),
        }
    )


def betting_results(games: DataFrame) -> DataFrame:
    """Add the cover margin and the results against the spread and the total."""
    margin = cover_margin("home_score", "away_score", "spread_line")
    return games.withColumns(
        {
            "cover_margin": margin,
            "ats_result": classify_ats_result(margin),
            "total_result": total_result("home_score", "away_score", "total_line"),
        }
    )


def winners(games: DataFrame) -> DataFrame:
    return games.withColumn("winner", game_winner())


def decided_finals(games: DataFrame, before_season: int | None = None) -> DataFrame:
    """Played final games with their winner; `before_season` leaves the season to predict out."""
    finals = final_games(games).filter("home_score IS NOT NULL AND away_score IS NOT NULL")
    if before_season is not None:
        finals = finals.filter(F.col("season") < before_season)
    return winners(
        finals.select(
            "season", "game_id", "home_team", "away_team",
            "home_score", "away_score", "spread_line", "total_line",
        )
    )


def team_profiles(
    plays: DataFrame, ratings: DataFrame, exclude_games: DataFrame | None = None
) -> DataFrame:
    """Regular season, postseason and ratings of each team season in one row."""
    seasons = team_season_profiles(plays, exclude_games)
    ranks = rating_features(ratings).withColumnRenamed("team", "posteam")
    return seasons.join(ranks, ["posteam", "season"], "left")


def coming_profiles(plays: DataFrame, roster_ratings: DataFrame, season: int) -> DataFrame:
    """Profiles for games still to come: the teams' season so far with the ratings of their
    current rosters (`team`, `qb_ovr`, `avg_ovr`, `max_ovr`)."""
    seasons = team_season_profiles(plays.filter(F.col("season") == season))
    ranks = roster_ratings.withColumnsRenamed({"team": "posteam", "avg_ovr": "avg_starter_ovr"})
    return seasons.join(ranks, "posteam", "left")


def difference(column: str) -> Column:
    home, away = F.col(f"home_{column}"), F.col(f"away_{column}")
    if column in MISSING:
        home, away = fill(home, MISSING[column]), fill(away, MISSING[column])
    return home - away


def matchup_features(games: DataFrame, profiles: DataFrame) -> DataFrame:
    """Games with the profiles of both teams and the sixteen model features.

    The profiles are settled once for both joins. Games with a `winner` column also get the
    target `home_win`; the same features serve training and scoring.
    """
    profiles = settle(profiles)
    home = prefix_columns(profiles, "home_", ["posteam", "season"])
    away = prefix_columns(profiles, "away_", ["posteam", "season"])
    both = attach(games, home, {"home_team": "posteam", "season": "season"}, settled=True)
    both = attach(both, away, {"away_team": "posteam", "season": "season"}, settled=True)
    spread = fill("spread_line", MISSING["spread_line"])
    features = {name: difference(column) for name, column in DIFFERENCES.items()}
    features |= {
        "spread_line": spread,
        "total_line": fill("total_line", MISSING["total_line"]),
        "implied_win_prob": spread_to_win_prob(spread),
    }
    if "winner" in games.columns:
        features["home_win"] = (F.col("home_team") == F.col("winner")).cast("int")
    return both.withColumns(features)
