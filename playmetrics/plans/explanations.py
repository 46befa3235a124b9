"""Texts about predictions, as column expressions over a predictions table.

A prediction row holds `home_team`, `away_team`, `predicted_winner`, `confidence` and
`contributions`, an array<struct<pos, feature, value>> with one entry per model feature. The
arrays are short and fixed in length, so ranking and wording happen inside the row: a whole
table is explained in one pass without a shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playmetrics.functions.codes import FEATURE_MEANINGS, FEATURE_PHRASES, TEAM_NAMES
from playmetrics.functions.scalars import as_column, literal_map, readable_feature

# The texts. Names in braces are filled in per row.
EXPLANATION_PROMPT = """You are an NFL analyst explaining a Super Bowl prediction to a casual fan.

MATCHUP: {home_team} vs {away_team}
PREDICTED WINNER: {winner} ({confidence} confidence)

FEATURE GLOSSARY (what each metric measures):
{glossary}

KEY FACTORS (contribution to prediction - positive means favors home team):
{factors}

Write 2-3 simple sentences explaining why {winner} is predicted to win.
Guidelines:
- Use everyday language a casual fan would understand
- Translate metrics like "Offensive Efficiency" to "more effective offense" or "better at moving the ball"
- Mention specific team names ({home_team} and {away_team}) rather than "home/away"
- Focus on the most impactful 2-3 factors
- Don't mention numbers, percentages, or technical terms"""

COMPARISON_PROMPT = """You are an NFL analyst providing a detailed breakdown of a Super Bowl matchup.

MATCHUP: {home_team} vs {away_team}
PREDICTION: {winner} wins ({confidence} confidence)

TEAM COMPARISON:
{features}

Provide a 3-4 sentence analysis breaking down:
1. Each team's strengths and weaknesses
2. The key matchup that will decide the game
3. Why the predicted winner has the edge

Use casual, engaging language that a sports fan would enjoy reading."""

CLEAR_FAVORITE = (
    "{winner} is projected to defeat {loser} ({confidence} confidence). "
    "The model heavily favors {winner} because they {first}. "
    "Additionally, they {second}. "
    "These combined advantages make {winner} a clear favorite heading into the Super Bowl."
)
MEANINGFUL_EDGE = (
    "{winner} holds a meaningful edge over {loser} ({confidence} confidence). "
    "{winner} {first}, giving them an advantage in this matchup. "
    "They also {second}, which tips the scales in their favor. "
    "Expect a competitive game, but {winner} has the edge."
)
CLOSE_CONTEST = (
    "In what projects to be a closely contested Super Bowl, {winner} has a slight edge over {loser} "
    "({confidence} confidence). "
    "While both teams are evenly matched, {winner} {first}. "
    "Small margins in {second_short} also favor {winner}. "
    "This one could go either way."
)
ONE_ADVANTAGE = (
    "{winner} is given a narrow edge over {loser} ({confidence} confidence). "
    "The key differentiator is that {winner} {first}. "
    "With both teams otherwise evenly matched, this factor could prove decisive."
)
NO_ADVANTAGE = (
    "The model projects {winner} to edge {loser} in a toss-up matchup ({confidence} confidence). "
    "Both teams are remarkably evenly matched across key metrics. "
    "The margin is razor-thin, and either team could hoist the Lombardi Trophy."
)
GAME_REPORT = """Super Bowl {season}: {home_team} vs {away_team}
  Predicted Winner: {winner} ({confidence} confident)
  Actual Winner: {actual}
  Result: {result}
  Feature Contributions:
{contributions}"""


REPORT_HEAD = """======================================================================
SUPER BOWL PREDICTION MODEL REPORT
Model: {model}
======================================================================

MODEL PERFORMANCE
----------------------------------------
Overall Accuracy: {accuracy}
Correct Predictions: {correct} / {games}
"""
REPORT_IMPORTANCE = """FEATURE IMPORTANCE
----------------------------------------
{lines}
"""
REPORT_GAMES = """INDIVIDUAL GAME BREAKDOWN
----------------------------------------
"""


def fill_in(text: str, parts: dict[str, Column]) -> Column:
    """The text with each `{name}` replaced by the column of that name."""
    pieces = re.split(r"\{(\w+)\}", text)
    return F.concat(*[parts[p] if i % 2 else F.lit(p) for i, p in enumerate(pieces) if i % 2 or p])


# --- numbers in text ---------------------------------------------------------------


def one_decimal(value: Column) -> Column:
    return F.format_string("%.1f", F.bround(F.abs(value), 1))


def signed(value: Column) -> Column:
    """One decimal with its sign, halves to even."""
    return F.concat(F.when(value < 0, "-").otherwise("+"), one_decimal(value))


def plain(value: Column) -> Column:
    return F.concat(F.when(value < 0, "-").otherwise(""), one_decimal(value))


def percent(share: Column, decimals: int = 0) -> Column:
    return F.format_string(f"%.{decimals}f%%", F.bround(share * 100, decimals))


# --- features ----------------------------------------------------------------------


def meaning(feature: Column, field: str) -> Column:
    """A field of the feature dictionary, NULL for an unknown feature."""
    return literal_map({f: getattr(m, field) for f, m in FEATURE_MEANINGS.items()})[feature]


def sign_meaning(feature: Column, value: Column) -> Column:
    return F.when(value > 0, meaning(feature, "positive")).otherwise(meaning(feature, "negative"))


def feature_explanation(feature: Column | str, value: Column | str) -> Column:
    """`Name: what this sign means`, or a generic text for an unknown feature."""
    f, v = as_column(feature), as_column(value)
    known = F.concat_ws(": ", meaning(f, "name"), sign_meaning(f, v))
    side = F.when(v > 0, "favors home team").otherwise("favors away team")
    generic = F.concat_ws(": ", readable_feature(f), side)
    return F.when(meaning(f, "name").isNotNull(), known).otherwise(generic)


def top_contributions(contributions: Column | str = "contributions", n: int = 5) -> Column:
    """The n entries of largest absolute value, earlier ones first among equals."""
    keyed = F.transform(
        as_column(contributions),
        lambda c: F.struct((-F.abs(c["value"])).alias("key"), c["pos"].alias("pos"), c.alias("entry")),
    )
    return F.transform(F.slice(F.array_sort(keyed), 1, n), lambda k: k["entry"])


def contribution_line(entry: Column, include_definitions: bool) -> Column:
    f, v = entry["feature"], entry["value"]
    side = F.when(v > 0, "favors home").otherwise("favors away")
    simple = F.concat(F.lit("- "), readable_feature(f), F.lit(": "), signed(v), F.lit(" pp ("), side, F.lit(")"))
    if not include_definitions:
        return simple
    defined = F.concat(
        F.lit("- "), meaning(f, "name"), F.lit(" ("), signed(v), F.lit(" pp): "), sign_meaning(f, v)
    )
    return F.coalesce(defined, simple)


def contribution_lines(
    contributions: Column | str = "contributions", top_n: int = 5, include_definitions: bool = True
) -> Column:
    lines = F.transform(
        top_contributions(contributions, top_n), lambda c: contribution_line(c, include_definitions)
    )
    return F.array_join(lines, "\n")


# --- prompts -----------------------------------------------------------------------


def matchup_parts() -> dict[str, Column]:
    return {
        "home_team": F.col("home_team"),
        "away_team": F.col("away_team"),
        "winner": F.col("predicted_winner"),
        "confidence": percent(F.col("confidence")),
    }


def explanation_prompt(contributions: Column | str = "contributions") -> Column:
    """The prompt with the top factors and a glossary of the first five features as given."""
    first = F.slice(as_column(contributions), 1, 5)
    known = F.filter(first, lambda c: meaning(c["feature"], "name").isNotNull())
    glossary = F.transform(
        known,
        lambda c: F.concat(
            F.lit("- "), meaning(c["feature"], "name"), F.lit(": "), meaning(c["feature"], "description")
        ),
    )
    return fill_in(
        EXPLANATION_PROMPT,
        {
            **matchup_parts(),
            "glossary": F.array_join(glossary, "\n"),
            "factors": contribution_lines(contributions),
        },
    )


def comparison_prompt(features: Column | str = "features") -> Column:
    """The prompt with all feature values, in the same array form as contributions."""

    def line(entry: Column) -> Column:
        f, v = entry["feature"], entry["value"]
        ahead = F.when(v > 0, F.col("home_team")).otherwise(F.col("away_team"))
        difference = F.concat(signed(v), F.lit(" ("), ahead, F.lit(" advantage)"))
        value = F.when(F.lower(f).contains("diff"), difference).otherwise(plain(v))
        return F.concat(F.lit("- "), readable_feature(f), F.lit(": "), value)

    lines = F.array_join(F.transform(as_column(features), line), "\n")
    return fill_in(COMPARISON_PROMPT, {**matchup_parts(), "features": lines})


# --- template texts ----------------------------------------------------------------


def team_name(code: Column) -> Column:
    return F.coalesce(literal_map(TEAM_NAMES)[code], code)


def winner_advantages(contributions: Column | str = "contributions") -> Column:
    """Of the four largest contributions those that speak for the predicted winner.

    A zero counts for the away team, and a feature with "def" in its name speaks for the
    side it is negative for.
    """
    home_wins = F.col("predicted_winner") == F.col("home_team")
    away_wins = F.col("predicted_winner") == F.col("away_team")
    known = F.array(*[F.lit(f) for f in FEATURE_PHRASES])

    def speaks_for_winner(c: Column) -> Column:
        v = c["value"]
        for_home = F.when(c["feature"].contains("def"), v < 0).otherwise(v > 0)
        return F.array_contains(known, c["feature"]) & ((for_home & home_wins) | (~for_home & away_wins))

    return F.filter(top_contributions(contributions, 4), speaks_for_winner)


def template_explanation(advantages: Column | str) -> Column:
    """The explanation from the winner's advantages, see `winner_advantages`."""
    phrase = literal_map({f: p for f, (p, _) in FEATURE_PHRASES.items()})
    short = literal_map({f: s for f, (_, s) in FEATURE_PHRASES.items()})
    adv = as_column(advantages)
    home_wins = F.col("predicted_winner") == F.col("home_team")
    first, second = F.get(adv, F.lit(0))["feature"], F.get(adv, F.lit(1))["feature"]
    parts = {
        "winner": team_name(F.col("predicted_winner")),
        "loser": team_name(F.when(home_wins, F.col("away_team")).otherwise(F.col("home_team"))),
        "confidence": percent(F.col("confidence")),
        "first": phrase[first],
        "second": phrase[second],
        "second_short": short[second],
    }
    two, one = F.size(adv) >= 2, F.size(adv) == 1
    return (
        F.when(two & (F.col("confidence") >= 0.65), fill_in(CLEAR_FAVORITE, parts))
        .when(two & (F.col("confidence") >= 0.55), fill_in(MEANINGFUL_EDGE, parts))
        .when(two, fill_in(CLOSE_CONTEST, parts))
        .when(one, fill_in(ONE_ADVANTAGE, parts))
        .otherwise(fill_in(NO_ADVANTAGE, parts))
    )


def explain_predictions(predicted: DataFrame, alias: str = "explanation") -> DataFrame:
    """Add the template explanation to every prediction."""
    with_advantages = predicted.withColumn("__advantages", winner_advantages())
    return with_advantages.withColumn(alias, template_explanation("__advantages")).drop("__advantages")


def game_report(contributions: Column | str = "contributions", actual: Column | str = "winner") -> Column:
    """The report section of one game, all contributions in model order."""
    right = F.col("predicted_winner") == as_column(actual)
    lines = F.transform(
        as_column(contributions),
        lambda c: F.concat(F.lit("    - "), c["feature"], F.lit(": "), signed(c["value"]), F.lit(" pp")),
    )
    return fill_in(
        GAME_REPORT,
        {
            **matchup_parts(),
            "season": F.col("season").cast("string"),
            "confidence": percent(F.col("confidence"), 1),
            "actual": as_column(actual),
            "result": F.when(right, "✓ CORRECT").otherwise("✗ INCORRECT"),
            "contributions": F.array_join(lines, "\n"),
        },
    )


def prediction_report(predicted: DataFrame, importances: DataFrame, model: str) -> DataFrame:
    """The report as ordered texts (`part`, `season`, `game_id`, `text`): the accuracy, the
    importances, and one text per game."""
    none = {"season": F.lit(None).cast("int"), "game_id": F.lit(None).cast("long")}

    def part(df: DataFrame, number: int, text: Column, **keys: Column) -> DataFrame:
        found = {**none, **keys}
        return df.select(F.lit(number).alias("part"), *[c.alias(k) for k, c in found.items()], text.alias("text"))

    summary = predicted.agg(
        F.count(F.lit(1)).alias("games"), F.count_if(F.col("predicted_winner") == F.col("winner")).alias("right")
    )
    head = {
        "model": F.lit(model),
        "accuracy": percent(F.try_divide("right", "games"), 1),
        "correct": F.col("right").cast("string"),
        "games": F.col("games").cast("string"),
    }
    # One entry per feature, the most important first.
    entry = F.struct((-F.col("importance")).alias("key"), "feature", "importance_pct")
    entries = importances.agg(F.array_sort(F.collect_list(entry)).alias("e"))

    def line(e: Column) -> Column:
        return F.concat(F.lit("  "), e["feature"], F.lit(": "), one_decimal(e["importance_pct"]), F.lit("%"))

    parts = [
        part(summary, 1, fill_in(REPORT_HEAD, head)),
        part(entries, 2, fill_in(REPORT_IMPORTANCE, {"lines": F.array_join(F.transform("e", line), "\n")})),
        part(predicted.sparkSession.range(1), 3, F.lit(REPORT_GAMES)),
        part(
            predicted,
            4,
            F.concat(game_report(), F.lit("\n")),
            season=F.col("season").cast("int"),
            game_id=F.col("game_id").cast("long"),
        ),
    ]
    report = parts[0]
    for p in parts[1:]:
        report = report.unionByName(p)
    return report.orderBy("part", "season", "game_id")


def feature_dictionary(spark: SparkSession) -> DataFrame:
    """The feature dictionary as a table, to join in SQL."""
    rows = [(f, *m) for f, m in FEATURE_MEANINGS.items()]
    return spark.createDataFrame(rows, "feature string, name string, description string, positive string, negative string")
