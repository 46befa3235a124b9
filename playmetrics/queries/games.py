"""Game queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from playmetrics.functions import scalars as S
from playmetrics.plans import matchups, players
from playmetrics.queries.base import query
from playmetrics.queries.seasons import DEFENSE, MATRIX, OFFENSE, PLAYOFFS
from playmetrics.sources import surrogate, tables


@query(
    "weather",
    """SELECT *,
         CASE WHEN lower(roof) IN ('dome', 'closed') THEN 'Indoor' ELSE 'Outdoor' END AS environment,
         CASE WHEN lower(roof) = 'dome' THEN CAST(72 AS DOUBLE) ELSE temp END AS temp_adjusted,
         CASE WHEN lower(roof) = 'dome' THEN CAST(0 AS DOUBLE) ELSE wind END AS wind_adjusted,
         CASE WHEN lower(roof) = 'dome' THEN CAST(0 AS DOUBLE)
              ELSE greatest(CAST(0 AS DOUBLE), 40 - temp) / 10 + greatest(CAST(0 AS DOUBLE), wind - 15) / 5
              END AS weather_impact_score
       FROM games""",
    ["games"],
    ["weather_impact_score"],
)
def weather(spark, sf_dir):
    return matchups.clean_weather(surrogate.games(spark, sf_dir))


@query(
    "ats_results",
    """SELECT *, CASE WHEN cover_margin > 0 THEN 'Favorite Cover' WHEN cover_margin < 0 THEN 'Underdog Cover'
                      ELSE 'Push' END AS ats_result
       FROM (SELECT game_id, home_score, away_score, spread_line,
                    home_score - away_score + spread_line AS cover_margin FROM games) AS g""",
    ["games"],
)
def ats_results(spark, sf_dir):
    columns = ["game_id", "home_score", "away_score", "spread_line", "cover_margin", "ats_result"]
    return matchups.betting_results(surrogate.games(spark, sf_dir)).select(*columns)


@query(
    "total_results",
    """SELECT game_id, home_score, away_score, total_line,
              CASE WHEN home_score + away_score > total_line THEN 'Over'
                   WHEN home_score + away_score < total_line THEN 'Under' ELSE 'Push' END AS total_result
       FROM games""",
    ["games"],
)
def total_results(spark, sf_dir):
    columns = ["game_id", "home_score", "away_score", "total_line", "total_result"]
    return matchups.betting_results(surrogate.games(spark, sf_dir)).select(*columns)


@query(
    "game_outcomes",
    """SELECT game_id, home_score, away_score, home_score + away_score AS total_points,
              abs(home_score - away_score) AS margin, home_score % 10 AS home_digit,
              away_score % 10 AS away_digit, abs(home_score - away_score) <= 7 AS one_score_game,
              abs(home_score - away_score) >= 14 AS blowout
       FROM games""",
    ["games"],
)
def game_outcomes(spark, sf_dir):
    games = surrogate.games(spark, sf_dir).select("game_id", "home_score", "away_score")
    return games.withColumns(S.game_outcomes())


@query(
    "implied_prob",
    """SELECT game_id, spread_line,
              CASE WHEN spread_line IS NOT NULL THEN greatest(CAST(0.05 AS DOUBLE),
                   least(CAST(0.95 AS DOUBLE), CAST(0.5 AS DOUBLE) - spread_line / 14)) END AS win_prob
       FROM games""",
    ["games"],
    ["win_prob"],
)
def implied_prob(spark, sf_dir):
    games = surrogate.games(spark, sf_dir).select("game_id", "spread_line")
    return games.withColumn("win_prob", S.spread_to_win_prob("spread_line"))


@query(
    "shrunk_prob",
    """SELECT game_id, home_prob, 1 - home_prob AS away_prob,
              CASE WHEN home_prob > 0.5 THEN home_team ELSE away_team END AS predicted_winner,
              greatest(home_prob, 1 - home_prob) AS confidence
       FROM (SELECT game_id, home_team, away_team, CAST(0.15 AS DOUBLE) + CAST(0.7 AS DOUBLE)
                    * greatest(CAST(0.05 AS DOUBLE), least(CAST(0.95 AS DOUBLE),
                      CAST(0.5 AS DOUBLE) - coalesce(spread_line, 0) / 14)) AS home_prob FROM games) AS g""",
    ["games"],
    ["home_prob", "away_prob", "confidence"],
)
def shrunk_prob(spark, sf_dir):
    """The market's probability pulled towards even, as the scores of a coming game are."""
    games = surrogate.games(spark, sf_dir).select("game_id", "home_team", "away_team", "spread_line")
    market = S.spread_to_win_prob(S.fill("spread_line", 0.0))
    rated = games.withColumn("home_prob", S.shrunk_probability(market))
    away = 1 - F.col("home_prob")
    winner = F.when(F.col("home_prob") > 0.5, F.col("home_team")).otherwise(F.col("away_team"))
    return rated.select(
        "game_id",
        "home_prob",
        away.alias("away_prob"),
        winner.alias("predicted_winner"),
        F.greatest("home_prob", away).alias("confidence"),
    )


WINNERS = "SELECT *, CASE WHEN home_score > away_score THEN home_team ELSE away_team END AS winner FROM games"


@query("winners", WINNERS, ["games"])
def winners(spark, sf_dir):
    return matchups.winners(surrogate.games(spark, sf_dir))


@query("final_games", "SELECT * FROM games WHERE game_type = 'SB'", ["games"])
def final_games(spark, sf_dir):
    return tables.final_games(surrogate.games(spark, sf_dir))


# --- matchups ----------------------------------------------------------------------

RATING_FEATURES = """
SELECT team, season, avg(overall) AS avg_starter_ovr, max(overall) AS max_ovr, min(overall) AS min_ovr,
       max(overall) FILTER (WHERE position = 'QB') AS qb_ovr
FROM ratings WHERE team IS NOT NULL GROUP BY team, season
"""

PROFILES = """
SELECT m.*, p.* EXCLUDE (posteam, season), r.* EXCLUDE (team, season)
FROM matrix m
LEFT JOIN playoffs p ON m.posteam = p.posteam AND m.season = p.season
LEFT JOIN rating_features r ON m.posteam = r.team AND m.season = r.season
"""

MATCHUPS = """
SELECT g.game_id, g.season, g.home_team, g.away_team, g.winner,
       h.off_epa - a.off_epa AS off_epa_diff,
       h.def_epa_allowed - a.def_epa_allowed AS def_epa_diff,
       h.pass_epa - a.pass_epa AS pass_epa_diff,
       h.rush_epa - a.rush_epa AS rush_epa_diff,
       h.off_success_rate - a.off_success_rate AS success_rate_diff,
       h.explosive_rate - a.explosive_rate AS explosive_rate_diff,
       h.redzone_epa - a.redzone_epa AS redzone_epa_diff,
       h.third_down_epa - a.third_down_epa AS third_down_epa_diff,
       h.turnover_diff - a.turnover_diff AS turnover_diff,
       coalesce(h.playoff_off_epa, 0) - coalesce(a.playoff_off_epa, 0) AS playoff_epa_diff,
       coalesce(h.qb_ovr, 80) - coalesce(a.qb_ovr, 80) AS qb_ovr_diff,
       coalesce(h.avg_starter_ovr, 80) - coalesce(a.avg_starter_ovr, 80) AS avg_ovr_diff,
       coalesce(h.max_ovr, 90) - coalesce(a.max_ovr, 90) AS max_ovr_diff,
       coalesce(g.spread_line, 0) AS spread_line, coalesce(g.total_line, 47) AS total_line,
       greatest(CAST(0.05 AS DOUBLE), least(CAST(0.95 AS DOUBLE),
                CAST(0.5 AS DOUBLE) - coalesce(g.spread_line, 0) / 14)) AS implied_win_prob,
       CAST(g.home_team = g.winner AS INT) AS home_win
FROM (SELECT * FROM winners WHERE game_type = 'SB') AS g
LEFT JOIN profiles h ON g.home_team = h.posteam AND g.season = h.season
LEFT JOIN profiles a ON g.away_team = a.posteam AND g.season = a.season
"""

MATCHUP_VIEWS = ["plays", "games", "ratings"]
MATCHUP_CTES = {
    "offense": OFFENSE,
    "defense": DEFENSE,
    "matrix": MATRIX,
    "playoffs": PLAYOFFS,
    "rating_features": RATING_FEATURES,
    "profiles": PROFILES,
    "winners": WINNERS,
    "matchups": MATCHUPS,
}
FEATURES = S.matchup_feature_columns()
WHOLE = {"turnover_diff", "qb_ovr_diff", "max_ovr_diff"}
MATCHUP_DOUBLES = [f for f in FEATURES if f not in WHOLE]
PROFILE_DOUBLES = [
    "off_epa", "def_epa_allowed", "avg_starter_ovr", "playoff_off_epa", "success_rate",
]


def final_matchups(spark, sf_dir):
    """The sixteen features and the target of every final game."""
    plays, games = surrogate.plays(spark, sf_dir), surrogate.games(spark, sf_dir)
    profiles = matchups.team_profiles(plays, surrogate.ratings(spark, sf_dir))
    return matchups.matchup_features(matchups.decided_finals(games), profiles)


@query(
    "team_profiles",
    """SELECT posteam, season, off_epa, def_epa_allowed, off_success_rate AS success_rate, turnover_diff,
              playoff_plays, playoff_off_epa, qb_ovr, avg_starter_ovr, max_ovr, min_ovr FROM profiles""",
    MATCHUP_VIEWS,
    PROFILE_DOUBLES,
    ctes=MATCHUP_CTES,
)
def team_profiles(spark, sf_dir):
    plays, ratings = surrogate.plays(spark, sf_dir), surrogate.ratings(spark, sf_dir)
    return matchups.team_profiles(plays, ratings).select(
        "posteam",
        "season",
        "off_epa",
        "def_epa_allowed",
        F.col("off_success_rate").alias("success_rate"),
        "turnover_diff",
        "playoff_plays",
        "playoff_off_epa",
        "qb_ovr",
        "avg_starter_ovr",
        "max_ovr",
        "min_ovr",
    )


@query(
    "matchup_features",
    "SELECT * FROM matchups",
    MATCHUP_VIEWS,
    MATCHUP_DOUBLES,
    ctes=MATCHUP_CTES,
)
def matchup_features(spark, sf_dir):
    columns = ["game_id", "season", "home_team", "away_team", "winner", *FEATURES, "home_win"]
    return final_matchups(spark, sf_dir).select(*columns)


COMING_SEASON = 2001


@query(
    "coming_matchups",
    f"SELECT * EXCLUDE (winner, home_win) FROM matchups WHERE season = {COMING_SEASON}",
    MATCHUP_VIEWS,
    MATCHUP_DOUBLES,
    ctes={
        **MATCHUP_CTES,
        "rating_features": f"""SELECT team, {COMING_SEASON} AS season, avg(overall) AS avg_starter_ovr,
                                      max(overall) AS max_ovr, min(overall) AS min_ovr,
                                      max(overall) FILTER (WHERE position = 'QB') AS qb_ovr
                               FROM ratings GROUP BY team""",
    },
)
def coming_matchups(spark, sf_dir):
    """One season's final games as they look before kick-off, rated by the whole rosters."""
    games = tables.final_games(surrogate.games(spark, sf_dir)).filter(F.col("season") == COMING_SEASON)
    rosters = players.team_roster_ratings(surrogate.ratings(spark, sf_dir), "position", "overall")
    profiles = matchups.coming_profiles(surrogate.plays(spark, sf_dir), rosters, COMING_SEASON)
    columns = ["game_id", "season", "home_team", "away_team", *FEATURES]
    return matchups.matchup_features(games, profiles).select(*columns)
