"""Team seasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playmetrics.functions.measures import (
    defensive_stats,
    postseason_features,
    team_defensive_features,
    team_game_stats,
    team_offensive_features,
)
from playmetrics.operators.ordered import rank_within_group
from playmetrics.operators.relational import rows_without
from playmetrics.operators.sizing import settle
from playmetrics.plans.seasons import scrimmage_plays

# Columns of the two sides that a team season may lack.
DEFENSE = [
    "def_epa_allowed", "def_epa_per_play", "opp_success_rate", "sacks", "qb_hits", "interceptions",
    "fumbles_forced", "redzone_epa_allowed", "third_down_epa_allowed",
]
POSTSEASON = ["playoff_off_epa", "playoff_off_epa_per_play", "playoff_plays"]


def team_features(
    plays: DataFrame, side: str = "offense", digits: int | None = None, **options
) -> DataFrame:
    """Team seasons of one side, ranked inside the season; with `digits` by rounded values."""
    offense = side == "offense"
    team = "posteam" if offense else "defteam"
    measures = team_game_stats() if offense else defensive_stats()
    stats = settle(scrimmage_plays(plays).groupBy(team, "season").agg(*measures))
    value = "total_epa" if offense else "epa_allowed"
    return rank_within_group(stats, value, "season", [team], digits=digits, **options)


def regular_plays(plays: DataFrame) -> DataFrame:
    return scrimmage_plays(plays).filter(F.col("season_type") == "REG")


def offense_seasons(plays: DataFrame) -> DataFrame:
    return regular_plays(plays).groupBy("posteam", "season").agg(*team_offensive_features())


def defense_seasons(plays: DataFrame) -> DataFrame:
    return regular_plays(plays).groupBy("defteam", "season").agg(*team_defensive_features())


def postseason(plays: DataFrame, exclude_games: DataFrame | None = None) -> DataFrame:
    """Postseason offense per team season.

    The final game counts too, which lets a model of that game see its own result; give its
    `game_id`s as `exclude_games` to leave it out.
    """
    rows = scrimmage_plays(plays).filter(F.col("season_type") == "POST")
    rows = rows_without(rows, exclude_games, "game_id")
    return rows.groupBy("posteam", "season").agg(*postseason_features())


# Columns of a play that the team seasons need.
NEEDED = [
    "season", "season_type", "play_type", "epa", "yardline_100", "down", "interception", "sack",
    "qb_hit", "fumble_lost", "fumble_forced",
]


def team_seasons(plays: DataFrame, exclude_games: DataFrame | None = None) -> DataFrame:
    """Regular offense, regular defense and postseason of each team season in one row.

    Each play counts for its offense and its defense, so one pass over the plays and one
    aggregate give all three; the partial rows, not the plays, are shuffled. Only teams with
    a regular offense get a row, and a side without plays is NULL.
    """
    offense, regular = F.col("__side") == "offense", F.col("season_type") == "REG"
    post = offense & (F.col("season_type") == "POST")
    rows = scrimmage_plays(plays).filter(F.col("season_type").isin("REG", "POST"))
    if exclude_games is not None:
        excluded = exclude_games.select(F.col("game_id").alias("__excluded")).distinct()
        rows = rows.join(excluded, rows["game_id"] == excluded["__excluded"], "left")
        post = post & F.col("__excluded").isNull()
    else:
        rows = rows.withColumn("__excluded", F.lit(None).cast("int"))
    sides = F.array(
        F.struct(F.col("posteam").alias("posteam"), F.lit("offense").alias("__side")),
        F.struct(F.col("defteam").alias("posteam"), F.lit("defense").alias("__side")),
    )
    both = rows.select(*NEEDED, "__excluded", F.inline(sides))

    def plays_of(condition: Column) -> Column:
        return F.count(F.when(condition, 1))

    parts = {
        "__offense": (offense & regular, team_offensive_features(offense & regular)),
        "__defense": (~offense & regular, team_defensive_features(~offense & regular)),
        "__post": (post, postseason_features(post)),
    }
    measures = [m for _, figures in parts.values() for m in figures]
    counts = [plays_of(condition).alias(name) for name, (condition, _) in parts.items()]
    seasons = both.groupBy("posteam", "season").agg(*measures, *counts)
    result = seasons.filter(F.col("__offense") > 0)
    named = F.col("posteam").isNotNull()
    return result.withColumns(
        {
            c: F.when(named & (F.col(side) > 0), F.col(c))
            for side, columns in (("__defense", DEFENSE), ("__post", POSTSEASON))
            for c in columns
        }
    ).drop(*parts)


def with_balance(seasons: DataFrame) -> DataFrame:
    """Add the turnover balance and the pressure rate to settled team seasons.

    `pressure_rate` divides by 0.6 times the number of team seasons, not of pass plays; the
    model does not use it.
    """
    rows = seasons.agg(F.count(F.lit(1)).alias("n")).scalar()
    taken = F.col("interceptions") + F.col("fumbles_forced")
    given = F.col("interceptions_thrown") + F.col("fumbles_lost")
    return seasons.withColumns(
        {
            "turnover_diff": taken - given,
            "pressure_rate": (F.col("sacks") + F.col("qb_hits")) / (rows * 0.6),
        }
    )


def team_season_matrix(plays: DataFrame) -> DataFrame:
    """Regular offense and defense of each team season side by side."""
    return with_balance(settle(team_seasons(plays).drop(*POSTSEASON)))


def team_season_profiles(plays: DataFrame, exclude_games: DataFrame | None = None) -> DataFrame:
    """The matrix with the postseason columns."""
    return with_balance(settle(team_seasons(plays, exclude_games)))
