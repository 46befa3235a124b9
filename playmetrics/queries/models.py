"""Model and explanation queries on the matchups of the final games."""

from __future__ import annotations

from pyspark.sql import functions as F

from playmetrics.functions.codes import FEATURE_MEANINGS, FEATURE_PHRASES, TEAM_NAMES
from playmetrics.functions.scalars import feature_category, matchup_feature_columns, readable_feature
from playmetrics.operators.relational import drop_missing
from playmetrics.operators.sizing import scratch_path, settle
from playmetrics.plans import explanations, models
from playmetrics.queries.base import query
from playmetrics.queries.games import MATCHUP_CTES, MATCHUP_VIEWS, final_matchups
from playmetrics.sources import sinks

FEATURES = matchup_feature_columns()
WEIGHTS = [(-1) ** i * (i + 1) / 10 for i in range(len(FEATURES))]
KEPT = ["game_id", "season", "home_team", "away_team", "winner"]


def known(alias: str) -> str:
    return " AND ".join(f"{alias}.{f} IS NOT NULL" for f in FEATURES)


COMPLETE = f"SELECT * FROM matchups m WHERE {known('m')} AND home_win IS NOT NULL"

SCALES = "SELECT " + ", ".join(
    f"avg({f}) AS {f}_mean, CASE WHEN min({f}) < max({f}) THEN stddev_pop({f}) ELSE 1 END AS {f}_scale"
    for f in FEATURES
) + " FROM complete"

SCALED = "SELECT game_id, home_win, " + ", ".join(
    f"({f} - {f}_mean) / {f}_scale AS {f}" for f in FEATURES
) + " FROM complete, scales"

LINEAR = "\nUNION ALL\n".join(
    f"SELECT game_id, {i} AS pos, '{f}' AS feature, CAST({w} AS DOUBLE) * {f} AS value FROM scaled"
    for i, (f, w) in enumerate(zip(FEATURES, WEIGHTS, strict=True))
)

CONTRIBUTION_CTES = {
    **MATCHUP_CTES,
    "complete": COMPLETE,
    "scales": SCALES,
    "scaled": SCALED,
    "linear": LINEAR,
}


def training(spark, sf_dir):
    return models.training_rows(final_matchups(spark, sf_dir))


def games_with_features(spark, sf_dir):
    """Complete matchups with team names, settled once for fitting and scoring."""
    rows = drop_missing(final_matchups(spark, sf_dir), [*FEATURES, models.TARGET])
    return settle(rows.select(*KEPT, models.TARGET, *FEATURES))


def linear_contributions(spark, sf_dir):
    """Games rated by the market, with contributions from fixed weights on scaled values."""
    games = games_with_features(spark, sf_dir)
    scales = models.fit_scales(games, FEATURES)
    rated = models.weighted_contributions(games, WEIGHTS, scales, FEATURES)
    home = F.col("implied_win_prob")
    return rated.withColumns(
        {
            "predicted_home_prob": home,
            "predicted_away_prob": 1 - home,
            "predicted_winner": F.when(home > 0.5, F.col("home_team")).otherwise(F.col("away_team")),
            "confidence": F.greatest(home, 1 - home),
        }
    )


PREDICTED = """
SELECT *, CASE WHEN implied_win_prob > 0.5 THEN home_team ELSE away_team END AS predicted_winner,
       CASE WHEN implied_win_prob > 0.5 THEN away_team ELSE home_team END AS predicted_loser,
       greatest(implied_win_prob, 1 - implied_win_prob) AS confidence
FROM complete
"""

RANKED = "SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY abs(value) DESC, pos) AS nth FROM linear"


MARGIN = "0.1 + " + " + ".join(f"CAST({w} AS DOUBLE) * {f}" for f, w in zip(FEATURES, WEIGHTS, strict=True))

# Replacing a feature by its mean takes its scaled value to 0.
REPLACED = "\nUNION ALL\n".join(
    f"""SELECT game_id, {i} AS pos, '{f}' AS feature,
               100 * (1 / (1 + exp(-margin)) - 1 / (1 + exp(-(margin - CAST({w} AS DOUBLE) * {f})))) AS value
        FROM (SELECT *, {MARGIN} AS margin FROM scaled) AS s"""
    for i, (f, w) in enumerate(zip(FEATURES, WEIGHTS, strict=True))
)


# --- models ------------------------------------------------------------------------


@query(
    "scaled_features",
    "SELECT * FROM scaled",
    MATCHUP_VIEWS,
    FEATURES,
    ctes=CONTRIBUTION_CTES,
)
def scaled_features(spark, sf_dir):
    train = training(spark, sf_dir)
    rows = models.scaled(train, models.fit_scales(train, FEATURES))
    return rows.withColumn(models.TARGET, F.col(models.TARGET).cast("int"))


@query("model_compare")
def model_compare(spark, sf_dir):
    return models.accuracy_table(spark, models.cross_validate(training(spark, sf_dir), folds=3))


@query("predictions")
def predictions(spark, sf_dir):
    games = games_with_features(spark, sf_dir)
    model = models.fit_model(games, "Logistic Regression")
    return models.predictions(games, model).select(
        *KEPT, "predicted_home_prob", "predicted_away_prob", "predicted_winner", "correct", "confidence"
    )


@query("shrunk_predictions")
def shrunk_predictions(spark, sf_dir):
    games = games_with_features(spark, sf_dir)
    model = models.fit_model(games, "Logistic Regression")
    return models.predictions(games, model, shrink=True).select(
        *KEPT, "predicted_home_prob", "predicted_away_prob", "predicted_winner", "confidence"
    )


@query("next_season_scores")
def next_season_scores(spark, sf_dir):
    """Train on the seasons before the last one, score the last one."""
    games = games_with_features(spark, sf_dir)
    last = games.agg(F.max("season").alias("season")).first()["season"]
    model = models.fit_model(games.filter(F.col("season") < last), "Logistic Regression")
    coming = games.filter(F.col("season") == last)
    return models.predictions(coming, model, shrink=True).select(
        *KEPT, "predicted_home_prob", "predicted_winner", "confidence", "correct"
    )


@query("prediction_summary")
def prediction_summary(spark, sf_dir):
    games = games_with_features(spark, sf_dir)
    model = models.fit_model(games, "Random Forest")
    return models.prediction_summary(models.predictions(games, model))


@query("importance")
def importance(spark, sf_dir):
    train = training(spark, sf_dir)
    return models.importance_table(train, models.fit_model(train, "Gradient Boosting"))


@query("importance_file")
def importance_file(spark, sf_dir):
    """The importance table written as CSV and read back."""
    train = training(spark, sf_dir)
    table = models.importance_table(train, models.fit_model(train, "Random Forest"))
    path = scratch_path(spark, "importance")
    return sinks.write_results(table.select("feature", "importance", "importance_pct"), path, "csv")


@query("fit_optimum", "SELECT feature, true AS at_optimum FROM names", ctes={
    "names": "SELECT unnest([" + ", ".join(f"'{f}'" for f in ["intercept", *FEATURES]) + "]) AS feature"
})
def fit_optimum(spark, sf_dir):
    """Whether the penalised loss has no slope left in any weight of the fitted linear model."""
    train = training(spark, sf_dir)
    model = models.fit_model(train, "Logistic Regression")
    slopes = models.loss_slopes(train, model)
    return slopes.select("feature", (F.abs("slope") < 1e-4).alias("at_optimum"))


@query(
    "tree_checks",
    """SELECT CAST(16 AS BIGINT) AS features, true AS adds_up, true AS in_range, true AS winner_follows, count(*) AS games
       FROM complete""",
    MATCHUP_VIEWS,
    ctes=CONTRIBUTION_CTES,
)
def tree_checks(spark, sf_dir):
    """What holds for every fitted forest: importances add up to 100 percent, probabilities lie
    between 0 and 1, and the winner is the likelier side."""
    games = games_with_features(spark, sf_dir)
    model = models.fit_model(games, "Random Forest")
    table = models.importance_table(games, model).agg(
        F.count(F.lit(1)).alias("features"), (F.abs(F.sum("importance_pct") - 100) < 1e-6).alias("adds_up")
    )
    home = F.col("predicted_home_prob")
    winner = F.when(home > 0.5, F.col("home_team")).otherwise(F.col("away_team"))
    rated = models.predictions(games, model).agg(
        F.bool_and(home.between(0, 1)).alias("in_range"),
        F.bool_and(F.col("predicted_winner") == winner).alias("winner_follows"),
        F.count(F.lit(1)).alias("games"),
    )
    return table.select(
        "features", "adds_up", *[rated.select(c).scalar().alias(c) for c in ("in_range", "winner_follows", "games")]
    )


# --- contributions -----------------------------------------------------------------


@query("contributions_shifted", REPLACED, MATCHUP_VIEWS, ["value"], ctes=CONTRIBUTION_CTES)
def contributions_shifted(spark, sf_dir):
    """Percentage points lost when one feature takes its mean, for fixed weights on scaled values."""
    train = training(spark, sf_dir)
    scales = models.fit_scales(train, FEATURES)
    slopes = {f: w / scales[f].deviation for f, w in zip(FEATURES, WEIGHTS, strict=True)}
    line = models.Line(0.1 - sum(s * scales[f].mean for f, s in slopes.items()), slopes)
    rated = models.shifted_contributions(train, line, {f: s.mean for f, s in scales.items()})
    return rated.select("game_id", F.inline("contributions"))


@query(
    "contributions_linear",
    "SELECT game_id, pos, feature, value FROM linear",
    MATCHUP_VIEWS,
    ["value"],
    ctes=CONTRIBUTION_CTES,
)
def contributions_linear(spark, sf_dir):
    return linear_contributions(spark, sf_dir).select("game_id", F.inline("contributions"))


@query("contributions_replace")
def contributions_replace(spark, sf_dir):
    games = games_with_features(spark, sf_dir)
    model = models.fit_model(games, "Logistic Regression")
    means = {f: s.mean for f, s in models.fit_scales(games, FEATURES).items()}
    rows = models.replacement_contributions(games, model, means)
    return rows.select("game_id", F.inline("contributions"))


@query(
    "top_contributions",
    "SELECT game_id, pos, feature, value FROM ranked WHERE nth <= 5",
    MATCHUP_VIEWS,
    ["value"],
    ctes={**CONTRIBUTION_CTES, "ranked": RANKED},
)
def top_contributions(spark, sf_dir):
    top = explanations.top_contributions("contributions", 5)
    return linear_contributions(spark, sf_dir).select("game_id", F.inline(top))


def values_sql(rows: list[tuple[str, ...]], columns: str) -> str:
    quoted = ["(" + ", ".join("'" + v.replace("'", "''") + "'" for v in row) + ")" for row in rows]
    return f"SELECT * FROM (VALUES {', '.join(quoted)}) AS t({columns})"


MEANINGS = values_sql([(f, *m) for f, m in FEATURE_MEANINGS.items()], "feature, name, description, positive, negative")


def readable_sql(feature: str) -> str:
    words = f"string_split(replace({feature}, '_diff', ''), '_')"
    return f"array_to_string(list_transform({words}, lambda w: upper(w[1]) || w[2:]), ' ')"


@query(
    "feature_texts",
    f"""SELECT l.game_id, l.feature, l.value,
              m.name || ': ' || CASE WHEN l.value > 0 THEN m.positive ELSE m.negative END AS explanation,
              CASE WHEN contains(l.feature, 'ovr') THEN 'Madden Rating'
                   WHEN contains(l.feature, 'spread') OR contains(l.feature, 'total')
                        OR contains(l.feature, 'implied') THEN 'Vegas Market'
                   ELSE 'PBP/EPA Stats' END AS category,
              {readable_sql("l.feature")} AS readable
       FROM linear l JOIN meanings m ON l.feature = m.feature""",
    MATCHUP_VIEWS,
    ["value"],
    ctes={**CONTRIBUTION_CTES, "meanings": MEANINGS},
)
def feature_texts(spark, sf_dir):
    """Every contribution with its wording, category and readable name."""
    rows = linear_contributions(spark, sf_dir).select("game_id", F.inline("contributions"))
    return rows.select(
        "game_id",
        "feature",
        "value",
        explanations.feature_explanation("feature", "value").alias("explanation"),
        feature_category("feature").alias("category"),
        readable_feature("feature").alias("readable"),
    )


FILE_PARTS = ", ".join(
    f"max(l.value) FILTER (WHERE l.feature = '{f}') AS contrib_{f}" for f in FEATURES
)


@query(
    "predictions_file",
    f"""SELECT g.season, g.home_team, g.away_team, g.winner AS actual_winner,
               g.implied_win_prob AS predicted_home_prob, 1 - g.implied_win_prob AS predicted_away_prob,
               g.predicted_winner, g.predicted_winner = g.winner AS correct, g.confidence, p.* EXCLUDE (game_id)
        FROM predicted g JOIN parts p ON g.game_id = p.game_id""",
    MATCHUP_VIEWS,
    ["predicted_home_prob", "predicted_away_prob", "confidence", *[f"contrib_{f}" for f in FEATURES]],
    ctes={
        **CONTRIBUTION_CTES,
        "predicted": PREDICTED,
        "parts": f"SELECT game_id, {FILE_PARTS} FROM linear l GROUP BY game_id",
    },
)
def predictions_file(spark, sf_dir):
    """The market's predictions with their contributions, written as CSV and read back."""
    rows = models.prediction_rows(linear_contributions(spark, sf_dir))
    return sinks.write_results(rows, scratch_path(spark, "predictions"), "csv")


@query(
    "market_summary",
    """SELECT count(*) AS games, count(*) FILTER (WHERE predicted_winner = winner) AS correct_games,
              avg(CAST(predicted_winner = winner AS INT)) AS accuracy FROM predicted""",
    MATCHUP_VIEWS,
    ["accuracy"],
    ctes={**CONTRIBUTION_CTES, "predicted": PREDICTED},
)
def market_summary(spark, sf_dir):
    rows = models.prediction_rows(linear_contributions(spark, sf_dir))
    return models.prediction_summary(rows)


# --- texts -------------------------------------------------------------------------

NAMES = values_sql(list(TEAM_NAMES.items()), "code, full_name")
PHRASES = values_sql([(f, *p) for f, p in FEATURE_PHRASES.items()], "feature, phrase, short_name")

ADVANTAGES = """
SELECT r.game_id, p.phrase, p.short_name, row_number() OVER (PARTITION BY r.game_id ORDER BY r.nth) AS nth
FROM ranked r JOIN predicted g ON r.game_id = g.game_id JOIN phrases p ON r.feature = p.feature
WHERE r.nth <= 4 AND (g.predicted_winner = g.home_team)
      = (CASE WHEN contains(r.feature, 'def') THEN r.value < 0 ELSE r.value > 0 END)
"""

SENTENCES = """
SELECT g.game_id, g.confidence,
       coalesce(nw.full_name, g.predicted_winner) AS winner, coalesce(nl.full_name, g.predicted_loser) AS loser,
       printf('%.0f%%', round_even(g.confidence * 100, 0)) AS pct,
       a.phrase AS primary_phrase, b.phrase AS secondary_phrase, b.short_name AS secondary_short
FROM predicted g
LEFT JOIN advantages a ON g.game_id = a.game_id AND a.nth = 1
LEFT JOIN advantages b ON g.game_id = b.game_id AND b.nth = 2
LEFT JOIN names nw ON g.predicted_winner = nw.code
LEFT JOIN names nl ON g.predicted_loser = nl.code
"""


def text_sql(text: str, columns: dict[str, str]) -> str:
    """The template as a concatenation of its pieces and columns."""
    quoted = "'" + text.replace("'", "''") + "'"
    for name, column in columns.items():
        quoted = quoted.replace("{" + name + "}", f"' || {column} || '")
    return quoted


SENTENCE_COLUMNS = {
    "winner": "winner",
    "loser": "loser",
    "confidence": "pct",
    "first": "primary_phrase",
    "second": "secondary_phrase",
    "second_short": "secondary_short",
}


def sentence_sql(text: str) -> str:
    return text_sql(text, SENTENCE_COLUMNS)


def number_sql(value: str, plus: str = "+") -> str:
    return f"(CASE WHEN {value} < 0 THEN '-' ELSE '{plus}' END || printf('%.1f', round_even(abs({value}), 1)))"


def percent_sql(share: str, digits: int = 0) -> str:
    return f"printf('%.{digits}f%%', round_even({share} * 100, {digits}))"


TEMPLATES = f"""
SELECT game_id, CASE
         WHEN secondary_phrase IS NOT NULL AND confidence >= 0.65 THEN {sentence_sql(explanations.CLEAR_FAVORITE)}
         WHEN secondary_phrase IS NOT NULL AND confidence >= 0.55 THEN {sentence_sql(explanations.MEANINGFUL_EDGE)}
         WHEN secondary_phrase IS NOT NULL THEN {sentence_sql(explanations.CLOSE_CONTEST)}
         WHEN primary_phrase IS NOT NULL THEN {sentence_sql(explanations.ONE_ADVANTAGE)}
         ELSE {sentence_sql(explanations.NO_ADVANTAGE)} END AS explanation
FROM sentences
"""


@query(
    "template_explanation",
    TEMPLATES,
    MATCHUP_VIEWS,
    ctes={
        **CONTRIBUTION_CTES,
        "ranked": RANKED,
        "predicted": PREDICTED,
        "names": NAMES,
        "phrases": PHRASES,
        "advantages": ADVANTAGES,
        "sentences": SENTENCES,
    },
)
def template_explanation(spark, sf_dir):
    explained = explanations.explain_predictions(linear_contributions(spark, sf_dir))
    return explained.select("game_id", "explanation")


LINES = f"""
SELECT game_id,
       string_agg('- ' || m.name || ' (' || {number_sql("value")} || ' pp): '
                  || CASE WHEN value > 0 THEN m.positive ELSE m.negative END, chr(10) ORDER BY nth)
         FILTER (WHERE nth <= 5) AS with_meanings,
       string_agg('- ' || {readable_sql("r.feature")} || ': ' || {number_sql("value")} || ' pp ('
                  || CASE WHEN value > 0 THEN 'favors home' ELSE 'favors away' END || ')', chr(10) ORDER BY nth)
         FILTER (WHERE nth <= 3) AS plain,
       string_agg('- ' || m.name || ': ' || m.description, chr(10) ORDER BY pos) FILTER (WHERE pos < 5) AS glossary,
       string_agg('    - ' || r.feature || ': ' || {number_sql("value")} || ' pp', chr(10) ORDER BY pos) AS report_lines
FROM ranked r JOIN meanings m ON r.feature = m.feature GROUP BY game_id
"""

RAW = "\nUNION ALL\n".join(
    f"SELECT game_id, {i} AS pos, '{f}' AS feature, round(CAST({f} AS DOUBLE), 9) AS value FROM complete"
    for i, f in enumerate(FEATURES)
)

COMPARED = f"""
SELECT r.game_id, string_agg('- ' || {readable_sql("feature")} || ': '
         || CASE WHEN contains(feature, 'diff') THEN {number_sql("value")} || ' ('
                      || CASE WHEN value > 0 THEN home_team ELSE away_team END || ' advantage)'
                 ELSE {number_sql("value", "")} END, chr(10) ORDER BY pos) AS feature_lines
FROM raw r JOIN predicted g ON r.game_id = g.game_id GROUP BY r.game_id
"""

TEXT_CTES = {
    **CONTRIBUTION_CTES,
    "ranked": RANKED,
    "predicted": PREDICTED,
    "meanings": MEANINGS,
    "lines": LINES,
}

MATCHUP_COLUMNS = {
    "home_team": "home_team",
    "away_team": "away_team",
    "winner": "predicted_winner",
    "confidence": percent_sql("confidence"),
}


@query(
    "prompt_text",
    f"""SELECT g.game_id, {text_sql(
        explanations.EXPLANATION_PROMPT, {**MATCHUP_COLUMNS, "glossary": "glossary", "factors": "with_meanings"}
    )} AS prompt FROM predicted g JOIN lines l ON g.game_id = l.game_id""",
    MATCHUP_VIEWS,
    ctes=TEXT_CTES,
)
def prompt_text(spark, sf_dir):
    rated = linear_contributions(spark, sf_dir)
    return rated.select("game_id", explanations.explanation_prompt().alias("prompt"))


@query(
    "comparison_text",
    f"""SELECT g.game_id, {text_sql(
        explanations.COMPARISON_PROMPT, {**MATCHUP_COLUMNS, "features": "feature_lines"}
    )} AS prompt FROM predicted g JOIN compared c ON g.game_id = c.game_id""",
    MATCHUP_VIEWS,
    ctes={**TEXT_CTES, "raw": RAW, "compared": COMPARED},
)
def comparison_text(spark, sf_dir):
    rated = linear_contributions(spark, sf_dir)
    # Differences of sums are known to a few digits; more would show how they were added up.
    values = models.contribution_array({f: F.round(F.col(f), 9) for f in FEATURES})
    return rated.select("game_id", explanations.comparison_prompt(values).alias("prompt"))


@query(
    "contribution_lines",
    "SELECT game_id, with_meanings, plain FROM lines",
    MATCHUP_VIEWS,
    ctes=TEXT_CTES,
)
def contribution_lines(spark, sf_dir):
    rated = linear_contributions(spark, sf_dir)
    return rated.select(
        "game_id",
        explanations.contribution_lines().alias("with_meanings"),
        explanations.contribution_lines(top_n=3, include_definitions=False).alias("plain"),
    )


REPORT_COLUMNS = {
    **MATCHUP_COLUMNS,
    "season": "season",
    "confidence": percent_sql("confidence", 1),
    "actual": "g.winner",
    "result": "CASE WHEN predicted_winner = g.winner THEN '✓ CORRECT' ELSE '✗ INCORRECT' END",
    "contributions": "report_lines",
}


@query(
    "game_reports",
    f"""SELECT g.game_id, {text_sql(explanations.GAME_REPORT, REPORT_COLUMNS)} AS report
        FROM predicted g JOIN lines l ON g.game_id = l.game_id""",
    MATCHUP_VIEWS,
    ctes=TEXT_CTES,
)
def game_reports(spark, sf_dir):
    rated = linear_contributions(spark, sf_dir)
    return rated.select("game_id", explanations.game_report().alias("report"))


@query("prediction_report")
def prediction_report(spark, sf_dir):
    """The report on a fitted model: accuracy, importances, and a text per game."""
    games = games_with_features(spark, sf_dir)
    model = models.fit_model(games, "Random Forest")
    means = {f: s.mean for f, s in models.fit_scales(games, FEATURES).items()}
    predicted = models.predictions(games, model)
    explained = settle(models.replacement_contributions(predicted, model, means))
    table = models.importance_table(games, model)
    return explanations.prediction_report(explained, table, "Random Forest")
