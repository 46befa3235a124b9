"""Declared schemas of the input tables; reading with them spares the inference pass."""

from __future__ import annotations

from playmetrics.functions.codes import MATCHUP_FEATURES

PLAYS = """
    game_id string, play_id int, season int, week int, season_type string, play_type string,
    posteam string, defteam string, passer_id string, passer string, name string,
    epa double, wp double, wpa double, cpoe double,
    yards_gained double, air_yards double, yards_after_catch double,
    passing_yards double, rushing_yards double,
    pass_attempt double, complete_pass double, pass_touchdown double, rush_touchdown double,
    interception double, sack double, qb_hit double, fumble_lost double, fumble_forced double,
    third_down_converted double, third_down_failed double,
    yardline_100 int, down int
"""

GAMES = """
    season int, game_id string, home_team string, away_team string, game_type string,
    home_score int, away_score int, spread_line double, total_line double,
    roof string, temp double, wind double
"""

RATINGS = """
    season int, super_bowl string, player_name string, position string, team string,
    overall int, speed int, awareness int, throwing_power int, throwing_accuracy int,
    strength int, agility int, acceleration int, catching int, route_running int
"""

ROSTER = """
    Player string, Pos string, OVR int, Age int, Spd int, Str int, Agi int, Acc int,
    Awr int, Btk int, Trk int, Cod int, Bcv int
"""

PREDICTIONS = """
    season int, home_team string, away_team string, actual_winner string,
    predicted_home_prob double, predicted_away_prob double, predicted_winner string,
    correct boolean, confidence double,
""" + ", ".join(f"contrib_{f} double" for f in MATCHUP_FEATURES)

IMPORTANCE = "feature string, importance double, importance_pct double"


def column_names(schema: str) -> list[str]:
    return [column.split()[0] for column in schema.split(",")]
