import math

import pytest

from playmetrics.functions import measures as M
from playmetrics.plans import players, seasons, teams

PLAY = (
    "game_id long, play_id int, season int, season_type string, play_type string, posteam string, "
    "defteam string, passer_id long, name string, epa double, cpoe double, air_yards double, "
    "yards_after_catch double, passing_yards double, rushing_yards double, pass_attempt int, "
    "complete_pass int, pass_touchdown int, rush_touchdown int, interception int, sack int, qb_hit int, "
    "fumble_lost int, fumble_forced int, third_down_converted int, third_down_failed int, "
    "yardline_100 int, down int, wp double"
)


def play(**fields):
    base = dict.fromkeys(c.split()[0] for c in PLAY.split(", "))
    base |= {"season": 2001, "season_type": "REG", "play_type": "pass", "posteam": "A", "defteam": "B", "passer_id": 1}
    return tuple((base | fields).values())


def plays(spark, *rows):
    made = [play(**{"game_id": 1, "play_id": i, **row}) for i, row in enumerate(rows)]
    return spark.createDataFrame(made, PLAY)


def test_sums_of_nothing_are_zero_and_means_null(spark):
    df = plays(spark, {"epa": None}, {"epa": None})
    row = df.groupBy("posteam").agg(*M.team_offensive_features()).first()
    assert row["off_epa"] == 0 and row["off_epa_per_play"] is None and row["off_success_rate"] is None
    assert row["pass_epa"] == 0 and row["rush_epa"] == 0 and row["rush_epa_per_play"] is None
    assert row["interceptions_thrown"] == 0


def test_shares_leave_unknown_rows_out(spark):
    df = plays(spark, {"epa": 1.0}, {"epa": -1.0}, {"epa": None}, {"epa": 2.0})
    row = df.agg(*M.team_game_stats()).first()
    assert row["plays"] == 4 and row["total_epa"] == 2.0
    assert row["epa_per_play"] == pytest.approx(2 / 3) and row["success_rate"] == pytest.approx(2 / 3)


def test_nan_is_larger_than_any_threshold(spark):
    df = plays(spark, {"epa": math.nan}, {"epa": -1.0})
    row = df.agg(*M.season_offense_snapshot()).first()
    assert row["success_rate"] == 0.5 and row["explosive_rate"] == 0.5 and math.isnan(row["off_epa"])


def test_first_team_and_name_follow_the_order_and_keep_null(spark):
    df = plays(
        spark,
        {"play_id": 9, "posteam": "LATE", "name": "late"},
        {"play_id": 2, "posteam": None, "name": "early"},
    )
    row = players.passer_seasons(df, ["game_id", "play_id"]).first()
    assert row["team"] is None and row["player_name"] == "early" and row["dropbacks"] == 2


def test_conditional_measures(spark):
    df = plays(
        spark,
        {"epa": 1.0, "yardline_100": 20, "down": 3, "interception": 1},
        {"epa": 2.0, "yardline_100": 21, "down": 1, "play_type": "run", "fumble_lost": 1},
        {"epa": 4.0, "yardline_100": None, "down": 3, "play_type": "run"},
    )
    row = df.agg(*M.team_offensive_features()).first()
    assert (row["pass_epa"], row["rush_epa"], row["redzone_epa"], row["third_down_epa"]) == (1.0, 6.0, 1.0, 5.0)
    assert (row["rush_epa_per_play"], row["third_down_epa_per_play"]) == (3.0, 2.5)
    assert (row["interceptions_thrown"], row["fumbles_lost"]) == (1, 1)
    row = df.agg(*M.team_defensive_features()).first()
    assert (row["def_epa_allowed"], row["redzone_epa_allowed"], row["third_down_epa_allowed"]) == (7.0, 1.0, 5.0)


def test_only_regular_scrimmage_plays_make_the_matrix(spark):
    df = plays(
        spark,
        {"epa": 1.0, "sack": 1, "qb_hit": 2},
        {"epa": 5.0, "season_type": "POST"},
        {"epa": 7.0, "play_type": "punt"},
        {"epa": 2.0, "posteam": "B", "defteam": "A", "interception": 1, "fumble_lost": 1, "fumble_forced": 1},
        {"epa": 3.0, "posteam": "C", "defteam": "Z"},
    )
    rows = {r["posteam"]: r for r in teams.team_season_matrix(df).collect()}
    assert rows["A"]["off_epa"] == 1.0 and rows["A"]["def_epa_allowed"] == 2.0
    assert rows["A"]["turnover_diff"] == 2 and rows["B"]["turnover_diff"] == -2
    # three team seasons: sacks and hits over 0.6 times three
    assert rows["B"]["pressure_rate"] == pytest.approx(3 / 1.8)
    assert rows["C"]["def_epa_allowed"] is None and rows["C"]["turnover_diff"] is None
    post = teams.postseason(df).collect()
    assert [(r["posteam"], r["playoff_off_epa"], r["playoff_plays"]) for r in post] == [("A", 5.0, 1)]
    without = spark.createDataFrame([(1,)], "game_id long")
    assert teams.postseason(df, without).count() == 0


@pytest.mark.parametrize("values", [[(1.0, 2.0), (1.0, 3.0)], [(1.0, 2.0)], [(1.0, None), (None, 2.0)], []])
def test_correlation_of_a_constant_is_null(spark, values):
    df = spark.createDataFrame(values, "x double, y double")
    assert df.agg(M.guarded_corr("x", "y")).first()[0] is None


def test_correlation_uses_complete_pairs(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0), (None, 100.0), (50.0, None)], "x double, y double")
    assert df.agg(M.guarded_corr("x", "y")).first()[0] == pytest.approx(1.0)


def test_team_without_quarterback_keeps_its_row(spark):
    df = spark.createDataFrame(
        [("2001", "A", "QB", 90), ("2001", "A", "WR", 95), ("2001", "B", "WR", 70), ("2001", None, "QB", 99)],
        "season string, team string, position string, overall int",
    )
    rows = {r["team"]: r for r in players.rating_features(df).collect()}
    assert set(rows) == {"A", "B"} and rows["A"]["season"] == 2001
    assert rows["A"]["qb_ovr"] == 90 and rows["A"]["max_ovr"] == 95 and rows["B"]["qb_ovr"] is None


def test_pass_rate(spark):
    df = plays(spark, {}, {"play_type": "run"}, {}, {"play_type": "punt"})
    row = seasons.season_pass_rate(df).first()
    assert (row["total_plays"], row["pass_plays"]) == (3, 2) and row["pass_rate"] == pytest.approx(200 / 3)


def test_snapshots_cover_all_season_types_of_one_season(spark):
    df = plays(spark, {"epa": 1.0}, {"epa": 2.0, "season_type": "POST"}, {"epa": 9.0, "season": 2002})
    assert seasons.offense_snapshot(df, 2001).first()["off_epa"] == 3.0
    assert seasons.defense_snapshot(df, 2001).first()["def_epa"] == 3.0
    assert seasons.team_coverage(df, 2002).first()["plays"] == 1


def test_data_quality(spark):
    games = spark.createDataFrame([("SB",), ("REG",), ("SB",)], "game_type string")
    row = seasons.data_quality(plays(spark, {}, {"season": 2005}), games).first()
    assert tuple(row) == (2001, 2005, 2, 2, 2)


def test_rank_of_null_stays_null(spark):
    df = plays(spark, {"passer_id": 1, "epa": 1.0}, {"passer_id": 2, "epa": None}, {"passer_id": 3, "epa": -1.0})
    rows = players.passer_features(df, ["game_id", "play_id"]).orderBy("passer_id").collect()
    assert [r["epa_per_dropback_rank"] for r in rows] == [1, None, 2]
    # a sum over no values is 0 and is ranked
    assert [r["total_epa_rank"] for r in rows] == [1, 2, 3]
