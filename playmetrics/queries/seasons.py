"""Season and team queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from playmetrics.functions.measures import team_game_stats
from playmetrics.functions.scalars import epa_per_play
from playmetrics.operators.relational import head, replace_seasons, tail
from playmetrics.operators.sizing import scratch_path
from playmetrics.plans import seasons, teams
from playmetrics.queries.base import DIGITS, query
from playmetrics.sources import sinks, surrogate, tables

RANKED_SEASON = 1999
REVISED_SEASON = 2000

OFFENSE = """
SELECT posteam, season,
       coalesce(sum(epa), 0) AS off_epa, avg(epa) AS off_epa_per_play,
       avg(CAST(epa > 0 AS INT)) AS off_success_rate,
       coalesce(sum(epa) FILTER (WHERE play_type = 'pass'), 0) AS pass_epa,
       avg(epa) FILTER (WHERE play_type = 'pass') AS pass_epa_per_play,
       coalesce(sum(epa) FILTER (WHERE play_type = 'run'), 0) AS rush_epa,
       avg(epa) FILTER (WHERE play_type = 'run') AS rush_epa_per_play,
       avg(CAST(epa > 1.5 AS INT)) AS explosive_rate,
       coalesce(sum(epa) FILTER (WHERE yardline_100 <= 20), 0) AS redzone_epa,
       avg(epa) FILTER (WHERE yardline_100 <= 20) AS redzone_epa_per_play,
       coalesce(sum(epa) FILTER (WHERE down = 3), 0) AS third_down_epa,
       avg(epa) FILTER (WHERE down = 3) AS third_down_epa_per_play,
       CAST(sum(interception) AS BIGINT) AS interceptions_thrown,
       CAST(sum(fumble_lost) AS BIGINT) AS fumbles_lost
FROM plays WHERE play_type IN ('pass', 'run') AND season_type = 'REG'
GROUP BY posteam, season
"""
OFFENSE_DOUBLES = [
    "off_epa", "off_epa_per_play", "off_success_rate", "pass_epa", "pass_epa_per_play", "rush_epa",
    "rush_epa_per_play", "explosive_rate", "redzone_epa", "redzone_epa_per_play", "third_down_epa",
    "third_down_epa_per_play",
]

DEFENSE = """
SELECT defteam, season,
       coalesce(sum(epa), 0) AS def_epa_allowed, avg(epa) AS def_epa_per_play,
       avg(CAST(epa > 0 AS INT)) AS opp_success_rate,
       CAST(sum(sack) AS BIGINT) AS sacks, CAST(sum(qb_hit) AS BIGINT) AS qb_hits,
       CAST(sum(interception) AS BIGINT) AS interceptions,
       CAST(sum(fumble_forced) AS BIGINT) AS fumbles_forced,
       coalesce(sum(epa) FILTER (WHERE yardline_100 <= 20), 0) AS redzone_epa_allowed,
       coalesce(sum(epa) FILTER (WHERE down = 3), 0) AS third_down_epa_allowed
FROM plays WHERE play_type IN ('pass', 'run') AND season_type = 'REG'
GROUP BY defteam, season
"""
DEFENSE_DOUBLES = [
    "def_epa_allowed", "def_epa_per_play", "opp_success_rate", "redzone_epa_allowed",
    "third_down_epa_allowed",
]

MATRIX = """
SELECT o.*, d.* EXCLUDE (defteam, season),
       (d.interceptions + d.fumbles_forced) - (o.interceptions_thrown + o.fumbles_lost) AS turnover_diff,
       (d.sacks + d.qb_hits) / ((SELECT count(*) FROM offense) * CAST(0.6 AS DOUBLE)) AS pressure_rate
FROM offense o LEFT JOIN defense d ON o.posteam = d.defteam AND o.season = d.season
"""

PLAYOFFS = """
SELECT posteam, season, coalesce(sum(epa), 0) AS playoff_off_epa,
       avg(epa) AS playoff_off_epa_per_play, count(*) AS playoff_plays
FROM plays WHERE play_type IN ('pass', 'run') AND season_type = 'POST'
GROUP BY posteam, season
"""

GAME_STATS = """
count(*) AS plays, coalesce(sum(epa), 0) AS total_epa, avg(epa) AS epa_per_play,
       avg(CAST(epa > 0 AS INT)) AS success_rate,
       count(*) FILTER (WHERE play_type = 'pass') AS pass_plays,
       coalesce(sum(passing_yards), 0) AS passing_yards,
       CAST(sum(pass_touchdown) AS BIGINT) AS pass_tds,
       CAST(sum(interception) AS BIGINT) AS interceptions,
       count(*) FILTER (WHERE play_type = 'run') AS rush_plays,
       coalesce(sum(rushing_yards), 0) AS rushing_yards,
       CAST(sum(rush_touchdown) AS BIGINT) AS rush_tds,
       CAST(sum(third_down_converted) AS BIGINT) AS third_down_conv,
       CAST(sum(third_down_failed) AS BIGINT) AS third_down_fail
"""


@query(
    "season_passing",
    "SELECT season, avg(epa) AS epa_per_play FROM plays WHERE play_type = 'pass' GROUP BY season ORDER BY season",
    ["plays"],
    ["epa_per_play"],
)
def season_passing(spark, sf_dir):
    return seasons.season_passing(surrogate.plays(spark, sf_dir))


@query(
    "season_pass_rate",
    """SELECT season, count(*) AS total_plays, count(*) FILTER (WHERE play_type = 'pass') AS pass_plays,
              100 * CAST(count(*) FILTER (WHERE play_type = 'pass') AS DOUBLE) / count(*) AS pass_rate
       FROM plays WHERE play_type IN ('pass', 'run') GROUP BY season""",
    ["plays"],
    ["pass_rate"],
)
def season_pass_rate(spark, sf_dir):
    return seasons.season_pass_rate(surrogate.plays(spark, sf_dir))


@query(
    "pass_filter_select",
    """SELECT game_id, season, name, epa, cpoe FROM plays
       WHERE play_type = 'pass' AND passer_id IS NOT NULL""",
    ["plays"],
)
def pass_filter_select(spark, sf_dir):
    rows = seasons.pass_plays(surrogate.plays(spark, sf_dir))
    return rows.select("game_id", "season", "name", "epa", "cpoe")


@query(
    "data_quality",
    """SELECT min(season) AS first_season, max(season) AS last_season,
              count(DISTINCT season) AS seasons, count(*) AS plays,
              (SELECT count(*) FROM games WHERE game_type = 'SB') AS final_games
       FROM plays""",
    ["plays", "games"],
)
def data_quality(spark, sf_dir):
    return seasons.data_quality(surrogate.plays(spark, sf_dir), surrogate.games(spark, sf_dir))


@query(
    "season_list",
    "SELECT DISTINCT season FROM plays",
    ["plays"],
)
def season_list(spark, sf_dir):
    return surrogate.plays(spark, sf_dir).select("season").distinct()


@query(
    "team_coverage",
    "SELECT season, posteam, count(*) AS plays FROM plays GROUP BY season, posteam",
    ["plays"],
)
def team_coverage(spark, sf_dir):
    return seasons.team_coverage(surrogate.plays(spark, sf_dir))


@query("team_offense", OFFENSE, ["plays"], OFFENSE_DOUBLES)
def team_offense(spark, sf_dir):
    return teams.offense_seasons(surrogate.plays(spark, sf_dir))


@query("team_defense", DEFENSE, ["plays"], DEFENSE_DOUBLES)
def team_defense(spark, sf_dir):
    return teams.defense_seasons(surrogate.plays(spark, sf_dir))


@query(
    "team_game_stats",
    f"""SELECT *, row_number() OVER (PARTITION BY season ORDER BY round(total_epa, 6) DESC, posteam) AS total_epa_rank
        FROM (SELECT posteam, season, {GAME_STATS}
              FROM plays WHERE play_type IN ('pass', 'run') GROUP BY posteam, season) AS stats""",
    ["plays"],
    ["total_epa", "epa_per_play", "success_rate"],
)
def team_offense_ranked(spark, sf_dir):
    return teams.team_features(surrogate.plays(spark, sf_dir), "offense", digits=DIGITS)


@query(
    "defensive_stats",
    """SELECT *, row_number() OVER (PARTITION BY season ORDER BY round(epa_allowed, 6) DESC, defteam) AS epa_allowed_rank
       FROM (SELECT defteam, season, count(*) AS plays_allowed, coalesce(sum(epa), 0) AS epa_allowed,
                    avg(epa) AS epa_per_play_allowed, avg(CAST(epa > 0 AS INT)) AS opp_success_rate,
                    CAST(sum(sack) AS BIGINT) AS sacks, CAST(sum(interception) AS BIGINT) AS turnovers_forced
             FROM plays WHERE play_type IN ('pass', 'run') GROUP BY defteam, season) AS stats""",
    ["plays"],
    ["epa_allowed", "epa_per_play_allowed", "opp_success_rate"],
)
def team_defense_ranked(spark, sf_dir):
    return teams.team_features(surrogate.plays(spark, sf_dir), "defense", digits=DIGITS)


@query(
    "team_game_rows",
    f"""SELECT *, total_epa / plays AS epa_per_row FROM (
          SELECT game_id, posteam, {GAME_STATS} FROM plays GROUP BY game_id, posteam) AS stats""",
    ["plays"],
    ["total_epa", "epa_per_play", "success_rate", "epa_per_row"],
)
def team_game_rows(spark, sf_dir):
    """The same measures per game, with total per row (which counts missing values too)."""
    stats = surrogate.plays(spark, sf_dir).groupBy("game_id", "posteam").agg(*team_game_stats())
    return stats.withColumn("epa_per_row", epa_per_play())


@query(
    "team_season_matrix",
    MATRIX,
    ["plays"],
    [*OFFENSE_DOUBLES, *DEFENSE_DOUBLES, "pressure_rate"],
    ctes={"offense": OFFENSE, "defense": DEFENSE},
)
def team_season_matrix(spark, sf_dir):
    return teams.team_season_matrix(surrogate.plays(spark, sf_dir))


@query("playoff_features", PLAYOFFS, ["plays"], ["playoff_off_epa", "playoff_off_epa_per_play"])
def playoff_features(spark, sf_dir):
    return teams.postseason(surrogate.plays(spark, sf_dir))


@query(
    "playoff_features_without_finals",
    PLAYOFFS.replace("'POST'", "'POST' AND game_id NOT IN (SELECT game_id FROM games WHERE game_type = 'SB')"),
    ["plays", "games"],
    ["playoff_off_epa", "playoff_off_epa_per_play"],
)
def playoff_features_without_finals(spark, sf_dir):
    finals = tables.final_games(surrogate.games(spark, sf_dir))
    return teams.postseason(surrogate.plays(spark, sf_dir), finals)


@query(
    "season_offense",
    f"""SELECT posteam, coalesce(sum(epa), 0) AS off_epa,
              coalesce(sum(epa) FILTER (WHERE play_type = 'pass'), 0) AS pass_epa,
              coalesce(sum(epa) FILTER (WHERE play_type = 'run'), 0) AS rush_epa,
              avg(CAST(epa > 0 AS INT)) AS success_rate, avg(CAST(epa > 1.5 AS INT)) AS explosive_rate
       FROM plays WHERE play_type IN ('pass', 'run') AND season = {RANKED_SEASON} GROUP BY posteam""",
    ["plays"],
    ["off_epa", "pass_epa", "rush_epa", "success_rate", "explosive_rate"],
)
def season_offense(spark, sf_dir):
    return seasons.offense_snapshot(surrogate.plays(spark, sf_dir), RANKED_SEASON)


@query(
    "season_defense",
    f"""SELECT defteam, coalesce(sum(epa), 0) AS def_epa FROM plays
        WHERE play_type IN ('pass', 'run') AND season = {RANKED_SEASON} GROUP BY defteam""",
    ["plays"],
    ["def_epa"],
)
def season_defense(spark, sf_dir):
    return seasons.defense_snapshot(surrogate.plays(spark, sf_dir), RANKED_SEASON)


@query(
    "recent_finals",
    """SELECT season, game_id, home_team, away_team, home_score, away_score, spread_line
       FROM games WHERE game_type = 'SB' ORDER BY season DESC, game_id DESC LIMIT 10""",
    ["games"],
)
def recent_finals(spark, sf_dir):
    finals = tables.final_games(surrogate.games(spark, sf_dir)).select(
        "season", "game_id", "home_team", "away_team", "home_score", "away_score", "spread_line"
    )
    return tail(finals, ["season", "game_id"], 10)


@query(
    "best_plays",
    """SELECT game_id, play_id, tie1, tie2, tie3, name, epa FROM plays WHERE epa IS NOT NULL
       ORDER BY epa DESC, game_id, play_id, tie1, tie2, tie3 LIMIT 20""",
    ["plays"],
)
def best_plays(spark, sf_dir):
    rows = surrogate.plays(spark, sf_dir).filter(F.col("epa").isNotNull())
    columns = [*surrogate.PLAY_ORDER, "name", "epa"]
    return head(rows.select(*columns), [F.col("epa").desc(), *surrogate.PLAY_ORDER], 20)


# --- season merge ------------------------------------------------------------------

REPLACED = f"""
SELECT * EXCLUDE (wp) REPLACE (CAST(down AS VARCHAR) AS down) FROM plays WHERE season <> {REVISED_SEASON}
UNION ALL BY NAME
SELECT * EXCLUDE (wp) REPLACE (epa + 1 AS epa, CAST(down AS VARCHAR) AS down) FROM plays
WHERE season = {REVISED_SEASON}
"""


@query("season_replace", REPLACED, ["plays"], ["epa"])
def season_replace(spark, sf_dir):
    """One season's rows revised, with one column missing and one of another type."""
    stored = surrogate.plays(spark, sf_dir)
    new = (
        stored.filter(F.col("season") == REVISED_SEASON)
        .withColumns({"epa": F.col("epa") + 1, "down": F.col("down").cast("string")})
        .drop("wp")
    )
    return replace_seasons(stored, new)


@query(
    "season_replace_files",
    f"""SELECT * REPLACE (CASE WHEN season = {REVISED_SEASON} THEN epa + 1 ELSE epa END AS epa)
        FROM (SELECT game_id, play_id, tie1, tie2, tie3, season, posteam, play_type, epa FROM plays) AS p""",
    ["plays"],
    ["epa"],
)
def season_replace_files(spark, sf_dir):
    """The same on a season-partitioned table: only the revised season's files are written anew."""
    columns = [*surrogate.PLAY_ORDER, "season", "posteam", "play_type", "epa"]
    path = scratch_path(spark, "plays")
    stored = sinks.write_seasons(surrogate.plays(spark, sf_dir).select(*columns), path)
    season = tables.only_seasons(stored, [REVISED_SEASON])
    new = season.withColumn("epa", F.col("epa") + 1)
    return sinks.merge_seasons(spark, path, new)
