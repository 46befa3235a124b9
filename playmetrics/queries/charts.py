"""Chart-data queries."""

from __future__ import annotations

from playmetrics.functions.scalars import game_outcomes
from playmetrics.operators import chartdata, ordered
from playmetrics.operators.sizing import settle, settle_table
from playmetrics.plans import players, seasons, teams
from playmetrics.queries.base import DIGITS, query
from playmetrics.queries.people import STATS
from playmetrics.queries.seasons import OFFENSE
from playmetrics.sources import surrogate
from playmetrics.sources.surrogate import PLAY_ORDER

ORDER = ", ".join(PLAY_ORDER)
TEAM = ["posteam", "season"]

PASSING = "SELECT season, avg(epa) AS epa_per_play FROM plays WHERE play_type = 'pass' GROUP BY season"


def fit_sql(x: str, y: str, over: str = "") -> str:
    return (
        f"CASE WHEN regr_count({y}, {x}) {over} > 2 "
        f"THEN regr_slope({y}, {x}) {over} * {x} + regr_intercept({y}, {x}) {over} END"
    )


@query(
    "trend",
    f"SELECT season, epa_per_play, {fit_sql('season', 'epa_per_play', 'OVER ()')} AS trend FROM passing",
    ["plays"],
    ["epa_per_play", "trend"],
    ctes={"passing": PASSING},
)
def trend(spark, sf_dir):
    return chartdata.trend(settle(seasons.season_passing(surrogate.plays(spark, sf_dir))))


@query(
    "trend_by_group",
    f"""SELECT posteam, season, off_epa_per_play,
               {fit_sql("season", "off_epa_per_play", "OVER (PARTITION BY posteam)")} AS trend FROM offense""",
    ["plays"],
    ["off_epa_per_play", "trend"],
    ctes={"offense": OFFENSE},
)
def trend_by_group(spark, sf_dir):
    rows = teams.offense_seasons(surrogate.plays(spark, sf_dir))
    rows = settle(rows.select("posteam", "season", "off_epa_per_play"))
    return chartdata.trend_by_group(rows, "posteam", "season", "off_epa_per_play")


@query(
    "outliers",
    f"""SELECT passer_id, season, dropbacks, total_epa, abs(total_epa - fit) AS residual
        FROM (SELECT *, {fit_sql("dropbacks", "total_epa", "OVER ()")} AS fit FROM stats) AS s
        ORDER BY round(residual, 6) DESC, passer_id, season LIMIT 10""",
    ["plays"],
    ["total_epa", "residual"],
    ctes={"stats": STATS},
)
def outliers(spark, sf_dir):
    stats = players.passer_seasons(surrogate.plays(spark, sf_dir), PLAY_ORDER)
    rows = settle(stats.select("passer_id", "season", "dropbacks", "total_epa"))
    return chartdata.outliers(rows, "dropbacks", "total_epa", ["passer_id", "season"], digits=DIGITS)


@query(
    "digit_matrix",
    """SELECT CAST(h.d AS INT) AS home_digit, CAST(a.d AS INT) AS away_digit,
              coalesce(games, 0) AS count, coalesce(100 * CAST(games AS DOUBLE) / total, 0) AS percent
       FROM (SELECT unnest(range(10)) AS d) AS h JOIN (SELECT unnest(range(10)) AS d) AS a ON TRUE
       LEFT JOIN (SELECT home_score % 10 AS hd, away_score % 10 AS ad, count(*) AS games,
                         CAST(sum(count(*)) OVER () AS BIGINT) AS total
                  FROM games GROUP BY 1, 2) AS c ON c.hd = h.d AND c.ad = a.d""",
    ["games"],
    ["percent"],
)
def digit_matrix(spark, sf_dir):
    return chartdata.digit_matrix(surrogate.games(spark, sf_dir).withColumns(game_outcomes()))


SIDES = """
SELECT CASE WHEN home_score > away_score THEN 'Winner' ELSE 'Loser' END AS result,
       home_score AS points FROM games
UNION ALL
SELECT CASE WHEN home_score > away_score THEN 'Loser' ELSE 'Winner' END, away_score FROM games
"""


@query(
    "box_stats",
    """SELECT result, CAST(min(points) AS DOUBLE) AS low, quantile_cont(CAST(points AS DOUBLE), 0.25) AS q1,
              quantile_cont(CAST(points AS DOUBLE), 0.5) AS median,
              quantile_cont(CAST(points AS DOUBLE), 0.75) AS q3, CAST(max(points) AS DOUBLE) AS high
       FROM sides GROUP BY result""",
    ["games"],
    ["low", "q1", "median", "q3", "high"],
    ctes={"sides": SIDES},
)
def box_stats(spark, sf_dir):
    games = surrogate.games(spark, sf_dir)
    sides = chartdata.winner_loser_rows(games, "home_score", "away_score", "points")
    return chartdata.box_stats(sides, "points", "result")


@query(
    "box_stats_by_season",
    """SELECT season, min(epa) AS low, quantile_cont(epa, 0.25) AS q1, quantile_cont(epa, 0.5) AS median,
              quantile_cont(epa, 0.75) AS q3, max(epa) AS high
       FROM plays WHERE epa IS NOT NULL GROUP BY season""",
    ["plays"],
    ["low", "q1", "median", "q3", "high"],
)
def box_stats_by_season(spark, sf_dir):
    rows = surrogate.plays(spark, sf_dir).select("season", "epa")
    return chartdata.box_stats(rows, "epa", "season")


@query(
    "histogram",
    """SELECT play_type, bin, low + (bin - 1) * width AS bin_start, low + bin * width AS bin_end, count(*) AS rows
       FROM (SELECT play_type, low, (high - low) / 30 AS width,
                    CAST(CASE WHEN low < high
                              THEN least(floor(30 * ((epa - low) / (high - low))) + 1, 30) ELSE 1 END AS INT) AS bin
             FROM plays, (SELECT min(epa) AS low, max(epa) AS high FROM plays) AS ends
             WHERE epa IS NOT NULL) AS b
       GROUP BY play_type, bin, low, width""",
    ["plays"],
    ["bin_start", "bin_end"],
)
def histogram(spark, sf_dir):
    rows = surrogate.plays(spark, sf_dir).select("play_type", "epa")
    return chartdata.histogram(rows, "epa", 30, "play_type")


MEASURES = ["epa", "cpoe", "air_yards", "yards_after_catch", "yards_gained", "wp"]


def correlation_sql(x: str, y: str) -> str:
    a = f"CASE WHEN {y} IS NOT NULL THEN {x} END"
    b = f"CASE WHEN {x} IS NOT NULL THEN {y} END"
    return f"""SELECT '{x}' AS x, '{y}' AS y, CASE WHEN min({a}) < max({a}) AND min({b}) < max({b})
               THEN corr({x}, {y}) END AS correlation FROM plays"""


@query(
    "corr_matrix",
    "\nUNION ALL\n".join(correlation_sql(x, y) for x in MEASURES for y in MEASURES),
    ["plays"],
    ["correlation"],
)
def corr_matrix(spark, sf_dir):
    return chartdata.correlation_matrix(surrogate.plays(spark, sf_dir), MEASURES)


@query(
    "season_series",
    "SELECT season AS x_season, off_epa_per_play, posteam FROM offense",
    ["plays"],
    ["off_epa_per_play"],
    ctes={"offense": OFFENSE},
)
def season_series(spark, sf_dir):
    rows = teams.offense_seasons(surrogate.plays(spark, sf_dir))
    return chartdata.series(rows, "season", "off_epa_per_play", "posteam").withColumnRenamed("season", "x_season")


@query(
    "rolling_series",
    f"""SELECT posteam, season, play_number, CASE WHEN count(epa) OVER w >= 10 THEN avg(epa) OVER w END AS rolling_epa_50
        FROM (SELECT *, row_number() OVER (PARTITION BY posteam, season ORDER BY {ORDER}) AS play_number
              FROM plays) AS p
        WINDOW w AS (PARTITION BY posteam, season ORDER BY play_number ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)""",
    ["plays"],
    ["rolling_epa_50"],
)
def rolling_series(spark, sf_dir):
    """Numbered plays of a team season with their rolling mean, ready to draw."""
    rows = settle_table(surrogate.plays(spark, sf_dir).select(*PLAY_ORDER, *TEAM, "epa"), "plays")
    numbered = ordered.number_rows(rows, "play_number", TEAM, PLAY_ORDER)
    drawn = ordered.rolling_epa(numbered, TEAM, ["play_number"])
    return chartdata.series(drawn, "play_number", "rolling_epa_50", TEAM)
