"""Passer seasons and their match with player ratings."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playmetrics.functions.measures import guarded_corr, qb_season_stats, ratings_features, roster_ratings
from playmetrics.functions.scalars import (
    normalize_player_name,
    standardize_position,
    standardize_team_abbr,
)
from playmetrics.operators.ordered import delta_from_previous, rank_within_group
from playmetrics.operators.relational import best_per_group
from playmetrics.operators.sizing import settle
from playmetrics.plans.seasons import pass_plays
from playmetrics.sources.tables import only_seasons

RANKED = ["total_epa", "epa_per_dropback", "success_rate"]


def passer_seasons(
    plays: DataFrame, order_by: Sequence[str], seasons: Iterable[int] | None = None
) -> DataFrame:
    rows = only_seasons(pass_plays(plays), seasons)
    return rows.groupBy("passer_id", "season").agg(*qb_season_stats(order_by))


def passer_features(
    plays: DataFrame,
    order_by: Sequence[str],
    seasons: Iterable[int] | None = None,
    digits: int | None = None,
    **options,
) -> DataFrame:
    """Passer seasons with three ranks inside the season and two changes from the passer's
    previous one. The aggregate is settled once: the size checks and windows all read it.
    With `digits` ranks compare rounded values."""
    stats = settle(passer_seasons(plays, order_by, seasons))
    ranked = rank_within_group(
        stats, RANKED, "season", ["passer_id"], digits=digits, **options
    )
    return delta_from_previous(
        ranked, ["total_epa", "epa_per_dropback"], ["season"], "passer_id", **options
    )


def qualified_passers(
    plays: DataFrame, order_by: Sequence[str], min_dropbacks: int = 200
) -> DataFrame:
    return passer_seasons(plays, order_by).filter(F.col("dropbacks") >= min_dropbacks)


def clean_ratings(ratings: DataFrame) -> DataFrame:
    return ratings.withColumns(
        {
            "name_normalized": normalize_player_name("player_name"),
            "team_std": standardize_team_abbr("team"),
            "position_std": standardize_position("position"),
        }
    )


def clean_names(df: DataFrame, name: str = "name") -> DataFrame:
    return df.withColumn("name_normalized", normalize_player_name(name))


def season_as_int(ratings: DataFrame) -> DataFrame:
    if dict(ratings.dtypes)["season"] == "string":
        return ratings.withColumn("season", F.col("season").try_cast("int"))
    return ratings


def rating_features(ratings: DataFrame) -> DataFrame:
    """Ratings per team season: mean, best and worst, and the best quarterback."""
    rows = season_as_int(ratings).filter(F.col("team").isNotNull())
    return rows.groupBy("team", "season").agg(*ratings_features())


def team_roster_ratings(rosters: DataFrame, position: str = "Pos", overall: str = "OVR") -> DataFrame:
    return rosters.groupBy("team").agg(*roster_ratings(position, overall))


def best_players(
    rosters: DataFrame, group: str | Sequence[str], value: str, ties: Sequence[str]
) -> DataFrame:
    return best_per_group(rosters, group, value, ties)


def ratings_match(
    ratings: DataFrame, plays: DataFrame, order_by: Sequence[str], min_dropbacks: int = 200
) -> DataFrame:
    """Quarterback ratings with the same player's season; unlike spellings meet in the key."""
    quarterbacks = clean_names(season_as_int(ratings), "player_name").filter(
        F.col("position") == "QB"
    )
    stats = clean_names(qualified_passers(plays, order_by, min_dropbacks), "player_name")
    right = stats.withColumnsRenamed({"player_name": "passer_name", "team": "passer_team"})
    return quarterbacks.join(right, ["name_normalized", "season"], "inner")


def ratings_correlation(matched: DataFrame) -> DataFrame:
    return matched.agg(
        guarded_corr("overall", "epa_per_dropback").alias("ovr_vs_epa"),
        guarded_corr("overall", "total_epa").alias("ovr_vs_total_epa"),
    )
