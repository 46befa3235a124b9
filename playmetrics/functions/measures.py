"""Lists of aggregate expressions for `groupBy(...).agg(*measures)`.

All of them combine on the map side, so a group that holds a large share of the rows costs
one partial row per task. A sum over no values is 0, a mean over no values is NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from playmetrics.functions.scalars import as_column


def total(value: Column | str) -> Column:
    return F.coalesce(F.sum(as_column(value)), F.lit(0))


def share(condition: Column) -> Column:
    """Share of true among the rows where the condition is known."""
    return F.avg(condition.cast("double"))


def total_where(condition: Column, value: Column | str) -> Column:
    return total(F.when(condition, as_column(value)))


def mean_where(condition: Column, value: Column | str) -> Column:
    return F.avg(F.when(condition, as_column(value)))


def guarded_corr(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation over complete pairs; NULL if either side is constant."""
    x, y = as_column(x), as_column(y)
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(
        varies, F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))
    )


def qb_season_stats(order_by: Sequence[str]) -> list[Column]:
    """Fourteen measures of a passer's season; team and name come from the first row in `order_by`."""
    first = F.min_by(
        F.struct(F.col("posteam").alias("team"), F.col("name").alias("player_name")),
        F.struct(*[F.col(c) for c in order_by]),
    )
    return [
        F.count(F.lit(1)).alias("dropbacks"),
        total("pass_attempt").alias("attempts"),
        total("complete_pass").alias("completions"),
        total("passing_yards").alias("passing_yards"),
        total("pass_touchdown").alias("touchdowns"),
        total("interception").alias("interceptions"),
        total("epa").alias("total_epa"),
        F.avg("epa").alias("epa_per_dropback"),
        share(F.col("epa") > 0).alias("success_rate"),
        F.avg("cpoe").alias("avg_cpoe"),
        F.avg("air_yards").alias("avg_air_yards"),
        F.avg("yards_after_catch").alias("avg_yac"),
        first["team"].alias("team"),
        first["player_name"].alias("player_name"),
    ]


def team_game_stats() -> list[Column]:
    """Thirteen offensive measures per team and season, or per team and game."""
    return [
        F.count(F.lit(1)).alias("plays"),
        total("epa").alias("total_epa"),
        F.avg("epa").alias("epa_per_play"),
        share(F.col("epa") > 0).alias("success_rate"),
        F.count_if(F.col("play_type") == "pass").alias("pass_plays"),
        total("passing_yards").alias("passing_yards"),
        total("pass_touchdown").alias("pass_tds"),
        total("interception").alias("interceptions"),
        F.count_if(F.col("play_type") == "run").alias("rush_plays"),
        total("rushing_yards").alias("rushing_yards"),
        total("rush_touchdown").alias("rush_tds"),
        total("third_down_converted").alias("third_down_conv"),
        total("third_down_failed").alias("third_down_fail"),
    ]


def defensive_stats() -> list[Column]:
    """Six measures of what a defense allowed."""
    return [
        F.count(F.lit(1)).alias("plays_allowed"),
        total("epa").alias("epa_allowed"),
        F.avg("epa").alias("epa_per_play_allowed"),
        share(F.col("epa") > 0).alias("opp_success_rate"),
        total("sack").alias("sacks"),
        total("interception").alias("turnovers_forced"),
    ]


def among(rows: Column | None, value: str) -> Column:
    """The value in some of the rows, or in all of them."""
    return F.col(value) if rows is None else F.when(rows, F.col(value))


def team_offensive_features(rows: Column | None = None) -> list[Column]:
    """Fourteen offensive measures of a team season for the matchup model."""
    epa = among(rows, "epa")
    passing, running = F.col("play_type") == "pass", F.col("play_type") == "run"
    red_zone, third_down = F.col("yardline_100") <= 20, F.col("down") == 3
    return [
        total(epa).alias("off_epa"),
        F.avg(epa).alias("off_epa_per_play"),
        share(epa > 0).alias("off_success_rate"),
        total_where(passing, epa).alias("pass_epa"),
        mean_where(passing, epa).alias("pass_epa_per_play"),
        total_where(running, epa).alias("rush_epa"),
        mean_where(running, epa).alias("rush_epa_per_play"),
        share(epa > 1.5).alias("explosive_rate"),
        total_where(red_zone, epa).alias("redzone_epa"),
        mean_where(red_zone, epa).alias("redzone_epa_per_play"),
        total_where(third_down, epa).alias("third_down_epa"),
        mean_where(third_down, epa).alias("third_down_epa_per_play"),
        total(among(rows, "interception")).alias("interceptions_thrown"),
        total(among(rows, "fumble_lost")).alias("fumbles_lost"),
    ]


def team_defensive_features(rows: Column | None = None) -> list[Column]:
    """Nine defensive measures of a team season for the matchup model."""
    epa = among(rows, "epa")
    return [
        total(epa).alias("def_epa_allowed"),
        F.avg(epa).alias("def_epa_per_play"),
        share(epa > 0).alias("opp_success_rate"),
        total(among(rows, "sack")).alias("sacks"),
        total(among(rows, "qb_hit")).alias("qb_hits"),
        total(among(rows, "interception")).alias("interceptions"),
        total(among(rows, "fumble_forced")).alias("fumbles_forced"),
        total_where(F.col("yardline_100") <= 20, epa).alias("redzone_epa_allowed"),
        total_where(F.col("down") == 3, epa).alias("third_down_epa_allowed"),
    ]


def postseason_features(rows: Column | None = None) -> list[Column]:
    epa = among(rows, "epa")
    return [
        total(epa).alias("playoff_off_epa"),
        F.avg(epa).alias("playoff_off_epa_per_play"),
        F.count(F.lit(1) if rows is None else F.when(rows, 1)).alias("playoff_plays"),
    ]


def season_offense_snapshot() -> list[Column]:
    """The five offensive measures used to score a coming game."""
    return [
        total("epa").alias("off_epa"),
        total_where(F.col("play_type") == "pass", "epa").alias("pass_epa"),
        total_where(F.col("play_type") == "run", "epa").alias("rush_epa"),
        share(F.col("epa") > 0).alias("success_rate"),
        share(F.col("epa") > 1.5).alias("explosive_rate"),
    ]


def ratings_features() -> list[Column]:
    """Best quarterback, mean, best and worst rating. A team without a quarterback gets NULL."""
    return [
        F.avg("overall").alias("avg_starter_ovr"),
        F.max("overall").alias("max_ovr"),
        F.min("overall").alias("min_ovr"),
        F.max(F.when(F.col("position") == "QB", F.col("overall"))).alias("qb_ovr"),
    ]


def roster_ratings(position: str = "Pos", overall: str = "OVR") -> list[Column]:
    return [
        F.max(F.when(F.col(position) == "QB", F.col(overall))).alias("qb_ovr"),
        F.avg(overall).alias("avg_ovr"),
        F.max(overall).alias("max_ovr"),
    ]
