import math

import pytest
from pyspark.sql import functions as F

from playmetrics.functions import codes
from playmetrics.functions import scalars as S


def apply(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in df.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


NAMES = {
    "Patrick Mahomes II": "PMAHOMES",
    "P.Mahomes": "PMAHOMES",
    "Ja'Marr Chase": "JCHASE",
    "Travis Kelce ": "TKELCE",
    "Tom Brady Jr.": "TBRADY",
    "A.J. Brown": "ABROWN",
    "J. Smith-Njigba": "JSMITHNJIGBA",
    "K. Walker III": "KWALKER",
    "Amon-Ra St. Brown": "ASTBROWN",
    "Robert Griffin the III": "RGRIFFINTHE",
    "Mercury": "MERCURY",
    "Patrick Mahomes II ": "PMAHOMESII",
    "José Núñez": "JNÚÑEZ",
    "Ann Lee": "ALEE",
    "Lee Jr.\n": "LJR",
    "": "",
    None: None,
}


def test_normalize_player_name(spark):
    assert apply(spark, list(NAMES), S.normalize_player_name) == list(NAMES.values())


def test_letters_only_name(spark):
    names = ["Patrick Mahomes II", "Ja'Marr Chase", "Travis Kelce ", "A.J. Brown", None]
    assert apply(spark, names, S.letters_only_name) == [
        "PATRICK MAHOMES II", "JAMARR CHASE", "TRAVIS KELCE", "AJ BROWN", None,
    ]


def test_first_and_last_name(spark):
    names = ["Tom Brady", "Mercury", "A.J. Brown", " x", "", None]
    assert apply(spark, names, lambda c: S.extract_first_last_name(c)[0]) == ["Tom", "Mercury", "A", None, None, None]
    assert apply(spark, names, lambda c: S.extract_first_last_name(c)[1]) == ["Brady", None, "Brown", "x", None, None]


def test_team_codes(spark):
    given = [*codes.TEAM_CODES, "KC", "kan", None]
    assert apply(spark, given, S.standardize_team_abbr) == [*codes.TEAM_CODES.values(), "KC", "kan", None]
    assert apply(spark, given, lambda c: S.standardize_team_abbr(c, source="plays")) == given
    assert apply(spark, ["LV", "LA", "TB", "X"], S.ratings_team_abbr) == ["OAK", "STL", "TAM", "X"]


def test_positions(spark):
    assert len(codes.POSITION_CODES) == 33
    given = [*codes.POSITION_CODES, "free safety", "hb", "Long Snapper", None]
    assert apply(spark, given, S.standardize_position) == [
        *codes.POSITION_CODES.values(), "FS", "RB", "Long Snapper", None,
    ]


def test_environment_and_weather(spark):
    rows = [
        ("dome", 10.0, 30.0), ("Closed", 30.0, 20.0), ("outdoors", None, 20.0), (None, 20.0, None),
        ("open", 50.0, 5.0),
    ]
    df = spark.createDataFrame(rows, "roof string, temp double, wind double")
    got = df.select(
        S.categorize_environment("roof"), S.adjusted_temp(), S.adjusted_wind(), S.weather_impact_score()
    ).collect()
    assert [tuple(r) for r in got] == [
        ("Indoor", 72.0, 0.0, 0.0),
        ("Indoor", 30.0, 20.0, 2.0),
        ("Outdoor", None, 20.0, 1.0),
        ("Outdoor", 20.0, None, 2.0),
        ("Outdoor", 50.0, 5.0, 0.0),
    ]


def test_results(spark):
    rows = [(24, 20, -3.5, 43.0), (20, 24, 4.0, 44.0), (10, 20, 3.0, 47.5), (None, 3, 1.0, 40.0), (7, 7, None, None)]
    df = spark.createDataFrame(rows, "h int, a int, spread double, line double")
    got = df.select(
        S.cover_margin("h", "a", "spread").alias("m"),
        S.classify_ats_result(S.cover_margin("h", "a", "spread")),
        S.total_result("h", "a", "line"),
        S.game_winner(F.lit("H"), F.lit("A"), "h", "a"),
    ).collect()
    assert [tuple(r) for r in got] == [
        (0.5, "Favorite Cover", "Over", "H"),
        (0.0, "Push", "Push", "A"),
        (-7.0, "Underdog Cover", "Under", "A"),
        (None, "Push", "Push", "A"),
        (None, "Push", "Push", "A"),
    ]


def test_game_outcomes(spark):
    df = spark.createDataFrame([(31, 17), (20, 27), (None, 3)], "home_score int, away_score int")
    got = df.select(*[c.alias(n) for n, c in S.game_outcomes().items()]).collect()
    assert tuple(got[0]) == (48, 14, 1, 7, False, True)
    assert tuple(got[1]) == (47, 7, 0, 7, True, False)
    assert tuple(got[2]) == (None, None, None, 3, None, None)


def test_probabilities(spark):
    assert apply(spark, [0.0, -7.0, 7.0, -3.5, None], S.spread_to_win_prob, "double") == [0.5, 0.95, 0.05, 0.75, None]
    assert apply(spark, [0.0, 1.0], S.shrunk_probability, "double") == pytest.approx([0.15, 0.85])


def test_ratio_of_zero_plays_is_null(spark):
    df = spark.createDataFrame([(3.0, 2), (3.0, 0)], "total_epa double, plays int")
    assert [r[0] for r in df.select(S.epa_per_play()).collect()] == [1.5, None]


def test_features(spark):
    features = ["qb_ovr_diff", "spread_line", "total_line", "implied_win_prob", "off_epa_diff"]
    assert apply(spark, features, S.feature_category) == [
        "Madden Rating", "Vegas Market", "Vegas Market", "Vegas Market", "PBP/EPA Stats",
    ]
    assert apply(spark, features, S.readable_feature) == [
        "Qb Ovr", "Spread Line", "Total Line", "Implied Win Prob", "Off Epa",
    ]
    assert len(S.matchup_feature_columns()) == 16


def test_clip_keeps_null_and_nan_is_large(spark):
    assert apply(spark, [None, 2.0, -1.0, 0.5, math.nan], lambda c: S.clip(c, 0.0, 1.0), "double") == [
        None, 1.0, 0.0, 0.5, 1.0,
    ]


def test_changes_to_next_season(spark):
    df = spark.createDataFrame(
        [(10.0, 4.0, 16, 12, 90, 85)],
        "epa_current_season double, epa_next_season double, games_current int, games_next int, "
        "rating_current int, rating_next int",
    )
    assert tuple(df.select(*S.next_season_changes().values()).first()) == (-6.0, 4, -5)
