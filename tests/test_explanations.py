import pytest
from pyspark.sql import functions as F

from playmetrics.functions.codes import FEATURE_MEANINGS, FEATURE_PHRASES, MATCHUP_FEATURES, TEAM_NAMES
from playmetrics.plans import explanations as E

ROW = (
    "season int, home_team string, away_team string, winner string, predicted_winner string, confidence double, "
    "contributions array<struct<pos:int,feature:string,value:double>>"
)


def prediction(spark, winner="KC", confidence=0.7, home="KC", away="SF", **values):
    entries = [(i, f, v) for i, (f, v) in enumerate(values.items())]
    return spark.createDataFrame([(2023, home, away, "KC", winner, confidence, entries)], ROW)


def text(df, column):
    return df.select(column.alias("t")).first()["t"]


def test_dictionaries_cover_the_features():
    assert list(FEATURE_MEANINGS) == list(FEATURE_PHRASES) == MATCHUP_FEATURES
    assert len(TEAM_NAMES) == 32 and "LA" not in TEAM_NAMES


def test_feature_explanation(spark):
    rows = [("off_epa_diff", 1.0), ("def_epa_diff", -1.0), ("spread_line", 0.0), ("rest_days_diff", 2.0), ("rest_days", 0.0)]
    df = spark.createDataFrame(rows, "f string, v double")
    assert [r[0] for r in df.select(E.feature_explanation("f", "v")).collect()] == [
        "Offensive Efficiency: Home team has a more efficient offense",
        "Defensive Efficiency: Home team allows fewer points (better defense)",
        "Vegas Spread: Home team is favored by Vegas",
        "Rest Days: favors home team",
        "Rest Days: favors away team",
    ]


def test_top_contributions_break_ties_by_position(spark):
    df = prediction(spark, a=1.0, b=-3.0, c=3.0, d=2.0)
    top = df.select(E.top_contributions(n=3).alias("t")).first()["t"]
    assert [c["feature"] for c in top] == ["b", "c", "d"]


def test_contribution_lines(spark):
    df = prediction(spark, off_epa_diff=8.54, rest_days_diff=-3.0, qb_ovr_diff=0.0)
    assert text(df, E.contribution_lines()) == (
        "- Offensive Efficiency (+8.5 pp): Home team has a more efficient offense\n"
        "- Rest Days: -3.0 pp (favors away)\n"
        "- Quarterback Rating (+0.0 pp): Away team has a higher-rated quarterback"
    )
    assert text(df, E.contribution_lines(top_n=1, include_definitions=False)) == "- Off Epa: +8.5 pp (favors home)"


@pytest.mark.parametrize(
    ("value", "expected"),
    [(0.25, "+0.2"), (0.75, "+0.8"), (-0.25, "-0.2"), (-0.04, "-0.0"), (0.0, "+0.0"), (12.349, "+12.3")],
)
def test_numbers_round_halves_to_even(spark, value, expected):
    assert text(spark.range(1), E.signed(F.lit(value))) == expected


def test_percent(spark):
    values = {0.625: "62%", 0.615: "62%", 0.999: "100%", 0.5: "50%"}
    for value, expected in values.items():
        assert text(spark.range(1), E.percent(F.lit(value))) == expected
    assert text(spark.range(1), E.percent(F.lit(0.9977), 1)) == "99.8%"


def test_clear_favorite(spark):
    df = prediction(spark, off_epa_diff=8.5, qb_ovr_diff=5.2, def_epa_diff=-3.1, spread_line=0.1, total_line=0.05)
    assert E.explain_predictions(df).first()["explanation"] == (
        "Kansas City is projected to defeat San Francisco (70% confidence). The model heavily favors Kansas City "
        "because they moved the ball more efficiently on offense. Additionally, they has the edge at quarterback, "
        "the game's most important position. These combined advantages make Kansas City a clear favorite heading "
        "into the Super Bowl."
    )


def test_edge_for_the_away_team(spark):
    df = prediction(spark, winner="SF", confidence=0.6, off_epa_diff=8.5, def_epa_diff=3.1, qb_ovr_diff=-1.0)
    assert E.explain_predictions(df).first()["explanation"].startswith(
        "San Francisco holds a meaningful edge over Kansas City (60% confidence). San Francisco limited opposing "
        "offenses more effectively, giving them an advantage in this matchup. They also has the edge at quarterback"
    )


def test_close_contest_uses_the_short_name(spark):
    df = prediction(spark, confidence=0.52, home="LA", winner="LA", rush_epa_diff=2.0, max_ovr_diff=1.0)
    got = E.explain_predictions(df).first()["explanation"]
    assert got.startswith("In what projects to be a closely contested Super Bowl, LA has a slight edge over San Francisco")
    assert "Small margins in star power also favor LA." in got


def test_one_and_no_advantage(spark):
    one = prediction(spark, off_epa_diff=1.0, pass_epa_diff=-2.0, unknown=9.0)
    assert "The key differentiator is that Kansas City moved the ball" in E.explain_predictions(one).first()["explanation"]
    none = prediction(spark, off_epa_diff=-1.0, pass_epa_diff=0.0)
    assert E.explain_predictions(none).first()["explanation"] == (
        "The model projects Kansas City to edge San Francisco in a toss-up matchup (70% confidence). Both teams are "
        "remarkably evenly matched across key metrics. The margin is razor-thin, and either team could hoist the "
        "Lombardi Trophy."
    )


def test_zero_counts_for_the_away_team_and_only_four_count(spark):
    df = prediction(spark, winner="SF", a=9.0, b=9.0, c=9.0, total_line=0.0, off_epa_diff=0.0)
    advantages = df.select(E.winner_advantages().alias("a")).first()["a"]
    assert [c["feature"] for c in advantages] == ["total_line"]


def test_empty_contributions(spark):
    got = E.explain_predictions(prediction(spark)).first()["explanation"]
    assert got.startswith("The model projects Kansas City to edge San Francisco")
    assert text(prediction(spark), E.contribution_lines()) == ""


def test_explanation_prompt(spark):
    df = prediction(spark, a_diff=1.0, off_epa_diff=2.0, pass_epa_diff=0.5, rush_epa_diff=0.1, b=0.0, qb_ovr_diff=9.0)
    got = text(df, E.explanation_prompt()).split("\n")
    assert got[2:4] == ["MATCHUP: KC vs SF", "PREDICTED WINNER: KC (70% confidence)"]
    start = got.index("FEATURE GLOSSARY (what each metric measures):")
    assert got[start + 1 : start + 4] == [
        "- Offensive Efficiency: Overall offensive performance difference (higher = better offense)",
        "- Passing Attack: Passing game efficiency difference",
        "- Running Game: Rushing efficiency difference",
    ]
    assert "- Quarterback Rating (+9.0 pp): Home team has a higher-rated quarterback" in got
    assert "- A: +1.0 pp (favors home)" in got
    assert "- Mention specific team names (KC and SF) rather than \"home/away\"" in got
    assert got[-1] == "- Don't mention numbers, percentages, or technical terms"


def test_comparison_prompt(spark):
    df = prediction(spark, off_epa_diff=2.0, pass_epa_diff=0.0, spread_line=-2.5)
    got = text(df, E.comparison_prompt("contributions")).split("\n")
    start = got.index("TEAM COMPARISON:")
    assert got[start + 1 : start + 4] == [
        "- Off Epa: +2.0 (KC advantage)", "- Pass Epa: +0.0 (SF advantage)", "- Spread Line: -2.5",
    ]


def test_game_report(spark):
    df = prediction(spark, off_epa_diff=2.0, spread_line=-31.25)
    assert text(df, E.game_report()) == (
        "Super Bowl 2023: KC vs SF\n  Predicted Winner: KC (70.0% confident)\n  Actual Winner: KC\n"
        "  Result: ✓ CORRECT\n  Feature Contributions:\n    - off_epa_diff: +2.0 pp\n    - spread_line: -31.2 pp"
    )


def test_prediction_report(spark):
    games = prediction(spark, off_epa_diff=2.0).withColumn("game_id", F.lit(7))
    lost = prediction(spark, winner="SF", off_epa_diff=-2.0).withColumns(
        {"game_id": F.lit(3), "season": F.lit(2020)}
    )
    importances = spark.createDataFrame(
        [("off_epa_diff", 0.25, 25.0), ("qb_ovr_diff", 0.75, 75.0)], "feature string, importance double, importance_pct double"
    )
    rows = E.prediction_report(games.unionByName(lost), importances, "Gradient Boosting").collect()
    assert [(r["part"], r["season"]) for r in rows] == [(1, None), (2, None), (3, None), (4, 2020), (4, 2023)]
    whole = "\n".join(r["text"] for r in rows)
    assert "Model: Gradient Boosting\n" in whole
    assert "Overall Accuracy: 50.0%\nCorrect Predictions: 1 / 2\n" in whole
    assert "  qb_ovr_diff: 75.0%\n  off_epa_diff: 25.0%\n" in whole
    assert "Super Bowl 2020: KC vs SF\n  Predicted Winner: SF (70.0% confident)" in whole


def test_feature_dictionary(spark):
    assert E.feature_dictionary(spark).count() == 16
