"""Season-level views of the plays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playmetrics.functions.measures import season_offense_snapshot, total

SCRIMMAGE = ("pass", "run")


def scrimmage_plays(plays: DataFrame) -> DataFrame:
    return plays.filter(F.col("play_type").isin(*SCRIMMAGE))


def pass_plays(plays: DataFrame) -> DataFrame:
    return plays.filter((F.col("play_type") == "pass") & F.col("passer_id").isNotNull())


def season_passing(plays: DataFrame) -> DataFrame:
    """Mean value of a pass play per season."""
    return (
        plays.filter(F.col("play_type") == "pass")
        .groupBy("season")
        .agg(F.avg("epa").alias("epa_per_play"))
        .orderBy("season")
    )


def season_pass_rate(plays: DataFrame) -> DataFrame:
    """Percent of pass plays among pass and run plays per season."""
    counts = scrimmage_plays(plays).groupBy("season").agg(
        F.count(F.lit(1)).alias("total_plays"),
        F.count_if(F.col("play_type") == "pass").alias("pass_plays"),
    )
    rate = F.try_divide(F.col("pass_plays"), F.col("total_plays")) * 100
    return counts.withColumn("pass_rate", rate).orderBy("season")


def data_quality(plays: DataFrame, games: DataFrame) -> DataFrame:
    """One row: season coverage, plays, and final games."""
    finals = games.agg(F.count_if(F.col("game_type") == "SB").alias("n")).scalar()
    return plays.agg(
        F.min("season").alias("first_season"),
        F.max("season").alias("last_season"),
        F.count_distinct("season").alias("seasons"),
        F.count(F.lit(1)).alias("plays"),
    ).withColumn("final_games", finals)


def team_coverage(plays: DataFrame, season: int | None = None) -> DataFrame:
    rows = plays if season is None else plays.filter(F.col("season") == season)
    return rows.groupBy("season", "posteam").agg(F.count(F.lit(1)).alias("plays"))


def offense_snapshot(plays: DataFrame, season: int) -> DataFrame:
    """Offense of each team in one season, all season types."""
    rows = scrimmage_plays(plays).filter(F.col("season") == season)
    return rows.groupBy("posteam").agg(*season_offense_snapshot())


def defense_snapshot(plays: DataFrame, season: int) -> DataFrame:
    rows = scrimmage_plays(plays).filter(F.col("season") == season)
    return rows.groupBy("defteam").agg(total("epa").alias("def_epa"))
