import pytest

from playmetrics.functions.codes import MATCHUP_FEATURES
from playmetrics.plans import matchups, models, players

PROFILE = (
    "posteam string, season int, off_epa double, def_epa_allowed double, pass_epa double, rush_epa double, "
    "off_success_rate double, explosive_rate double, redzone_epa double, third_down_epa double, "
    "turnover_diff long, playoff_off_epa double, qb_ovr int, avg_starter_ovr double, max_ovr int"
)
GAME = (
    "season int, game_id long, home_team string, away_team string, home_score int, away_score int, "
    "spread_line double, total_line double"
)


@pytest.fixture(scope="module")
def profiles(spark):
    return spark.createDataFrame(
        [
            ("A", 2001, 10.0, 5.0, 6.0, 4.0, 0.5, 0.2, 3.0, 2.0, 4, 7.0, 95, 85.0, 99),
            ("B", 2001, 8.0, 9.0, 7.0, 1.0, 0.4, 0.3, 1.0, 2.5, -1, None, None, None, None),
        ],
        PROFILE,
    )


def features(spark, profiles, *games):
    df = spark.createDataFrame(games, GAME)
    return matchups.matchup_features(matchups.winners(df), profiles)


def test_differences_and_stand_ins(spark, profiles):
    row = features(spark, profiles, (2001, 1, "A", "B", 20, 10, None, None)).first().asDict()
    expected = [2.0, -4.0, -1.0, 3.0, 0.1, -0.1, 2.0, -0.5, 5, 7.0, 15, 5.0, 9, 0.0, 47.0, 0.5]
    assert [row[f] for f in MATCHUP_FEATURES] == pytest.approx(expected)
    assert row["winner"] == "A" and row["home_win"] == 1
    assert row["home_off_epa"] == 10.0 and row["away_off_epa"] == 8.0


def test_swapping_sides_flips_the_sign(spark, profiles):
    rows = features(
        spark, profiles, (2001, 1, "A", "B", 20, 10, -3.0, 40.0), (2001, 2, "B", "A", 10, 20, 3.0, 40.0)
    ).orderBy("game_id").collect()
    for f in MATCHUP_FEATURES[:13]:
        assert rows[0][f] == pytest.approx(-rows[1][f])
    assert rows[0]["implied_win_prob"] + rows[1]["implied_win_prob"] == pytest.approx(1.0)
    assert (rows[0]["home_win"], rows[1]["home_win"]) == (1, 0)


def test_unknown_team_gives_null_differences_and_is_dropped(spark, profiles):
    got = features(spark, profiles, (2001, 1, "A", "Z", 20, 10, 1.0, 40.0), (2002, 2, "A", "B", 3, 3, 1.0, 40.0))
    row = got.orderBy("game_id").first()
    assert row["off_epa_diff"] is None and row["playoff_epa_diff"] == 7.0 and row["qb_ovr_diff"] == 15
    assert got.count() == 2
    assert models.training_rows(got).count() == 0


def test_scoring_uses_the_same_features_without_a_winner(spark, profiles):
    df = spark.createDataFrame([(2001, 1, "A", "B", None, None, 2.5, 47.5)], GAME)
    got = matchups.matchup_features(df, profiles)
    assert "home_win" not in got.columns and got.first()["implied_win_prob"] == pytest.approx(0.5 - 2.5 / 14)


def test_decided_finals(spark):
    games = spark.createDataFrame(
        [
            (2001, 1, "A", "B", 7, 3, 1.0, 40.0, "SB"),
            (2002, 2, "A", "B", 7, 7, 1.0, 40.0, "SB"),
            (2001, 3, "A", "B", 1, 2, 1.0, 4.0, "REG"),
        ],
        GAME + ", game_type string",
    )
    got = matchups.decided_finals(games).orderBy("game_id").collect()
    assert [(r["game_id"], r["winner"]) for r in got] == [(1, "A"), (2, "B")]
    assert matchups.decided_finals(games, before_season=2002).count() == 1


def test_ratings_match_keeps_both_names(spark):
    ratings = spark.createDataFrame(
        [("2001", "Pat Example II", "QB", "A", 90), ("2001", "Pat Example", "WR", "A", 80)],
        "season string, player_name string, position string, team string, overall int",
    )
    columns = (
        "game_id int, play_id int, season int, play_type string, passer_id int, posteam string, name string, "
        "epa double, cpoe double, air_yards double, yards_after_catch double, passing_yards double, "
        "pass_attempt int, complete_pass int, pass_touchdown int, interception int"
    )
    plays = spark.createDataFrame(
        [(1, i, 2001, "pass", 5, "B", "P.Example", 1.0, 1.0, 1.0, 1.0, 1.0, 1, 1, 0, 0) for i in range(3)], columns
    )
    order = ["game_id", "play_id"]
    row = players.ratings_match(ratings, plays, order, 3).collect()
    assert len(row) == 1
    assert (row[0]["player_name"], row[0]["team"], row[0]["passer_name"], row[0]["passer_team"]) == (
        "Pat Example II", "A", "P.Example", "B",
    )
    assert players.ratings_match(ratings, plays, order, 4).count() == 0
