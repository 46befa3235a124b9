"""Held-out predictions, and tree models given as node tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from playmetrics.operators.sizing import scratch_path, settle
from playmetrics.plans import folds, models, trees
from playmetrics.queries.base import query
from playmetrics.queries.games import MATCHUP_VIEWS
from playmetrics.queries.models import CONTRIBUTION_CTES, FEATURES, KEPT, games_with_features, training
from playmetrics.sources import sinks

# --- Leave-one-out ---------------------------------------------------------------------------------

MARKET = "implied_win_prob"

# Newton steps for one feature and an intercept, all left-out games side by side. The penalty on the scaled slope is
# 1 / C = 2; a game whose other games all have one outcome gets that outcome.
MARKET_FITS = f"""
WITH RECURSIVE f AS (
    SELECT game_id, CAST(home_win AS DOUBLE) AS y, CAST({MARKET} AS DOUBLE) AS x FROM complete
), others AS (
    SELECT o.game_id AS fold, avg(r.x) AS m, CASE WHEN min(r.x) < max(r.x) THEN stddev_pop(r.x) ELSE 1 END AS s, avg(r.y) AS share
    FROM f o JOIN f r ON r.game_id <> o.game_id GROUP BY 1
), steps(fold, i, w, b) AS (
    SELECT fold, 0, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM others WHERE share > 0 AND share < 1
    UNION ALL
    SELECT fold, i + 1, w - (hbb * gw - hwb * gb) / (hww * hbb - hwb * hwb), b - (hww * gb - hwb * gw) / (hww * hbb - hwb * hwb)
    FROM (
        SELECT fold, i, w, b, sum(p - y) AS gb, sum((p - y) * z) + 2 * w AS gw, sum(p * (1 - p)) AS hbb,
            sum(p * (1 - p) * z) AS hwb, sum(p * (1 - p) * z * z) + 2 AS hww
        FROM (
            SELECT t.*, r.y, (r.x - o.m) / o.s AS z, 1 / (1 + exp(-(t.w * (r.x - o.m) / o.s + t.b))) AS p
            FROM steps t JOIN others o ON o.fold = t.fold JOIN f r ON r.game_id <> t.fold WHERE t.i < 12
        ) AS rows GROUP BY fold, i, w, b
    ) AS sums
)
SELECT f.game_id, f.y AS home_win,
    CASE WHEN o.share IN (0, 1) THEN o.share ELSE 1 / (1 + exp(-(t.w * (f.x - o.m) / o.s + t.b))) END AS held_out_prob
FROM f JOIN others o ON o.fold = f.game_id LEFT JOIN steps t ON t.fold = f.game_id AND t.i = 12
"""


@query(
    "leave_one_out_market",
    "SELECT *, (held_out_prob > 0.5) = (home_win > 0.5) AS correct FROM fits",
    MATCHUP_VIEWS,
    ["held_out_prob"],
    ctes={**CONTRIBUTION_CTES, "fits": f"SELECT * FROM ({MARKET_FITS}) AS fitted"},
)
def leave_one_out_market(spark, sf_dir):
    """Every game by a linear model on the market's probability that never saw the game."""
    return folds.held_out(training(spark, sf_dir), None, [MARKET]).drop("fold")


@query("leave_one_out")
def leave_one_out(spark, sf_dir):
    """Every game by a linear model on all features that never saw the game."""
    return folds.held_out(training(spark, sf_dir), None, FEATURES).drop("fold")


@query("leave_one_out_summary")
def leave_one_out_summary(spark, sf_dir):
    return folds.held_out_summary(folds.held_out(training(spark, sf_dir), None, FEATURES))


@query("three_folds")
def three_folds(spark, sf_dir):
    return folds.held_out(training(spark, sf_dir), 3, FEATURES)


@query("best_model")
def best_model(spark, sf_dir):
    """The choice between the three models over three folds, a tie to the earlier name, and how the chosen
    one, fitted on all rows, does on them."""
    games = games_with_features(spark, sf_dir)
    name, model = models.fit_best(games, 3, FEATURES)
    refit = models.prediction_summary(models.predictions(games, model))
    return refit.select(F.lit(name).alias("model"), "games", "correct_games", "accuracy")


# --- Trees by a rule: thresholds around the mean of a feature, so any engine can make the same ones ---------

TREES, INNER = 9, 7
LINKS = (trees.MEAN, trees.LOGISTIC)


def rule(tree: int, node: int) -> dict:
    """A complete tree of depth 3: the feature and threshold (in deviations from its mean) of nodes 0 to 6, leaf values
    of nodes 7 to 14."""
    inner = node < INNER
    return {
        "feature": FEATURES[(5 * tree + 3 * node) % len(FEATURES)] if inner else None,
        "offset": ((tree + node) % 4 - 1.5) * 0.4 if inner else None,
        "left": 2 * node + 1 if inner else None,
        "right": 2 * node + 2 if inner else None,
        "value": None if inner else ((7 * tree + 5 * node) % 11) / 10,
        "gain": ((tree + 2 * node) % 7 + 1) / 10 if inner else None,
        "rows": 100 - 6 * node,
    }


def weight(tree: int, link: str) -> float:
    return 1.0 if link == trees.MEAN or tree == 0 else 0.1


RULE = [(t, n, rule(t, n)) for t in range(TREES) for n in range(2 * INNER + 1)]


def node_rows(spark, scales: dict[str, models.Scale], link: str):
    """The node table of the rule; a boosted model's leaves are centred."""
    rows = []
    for t, n, r in RULE:
        f = r["feature"]
        threshold = None if f is None else scales[f].mean + r["offset"] * scales[f].deviation
        value = None if r["value"] is None else r["value"] - (0.5 if link == trees.LOGISTIC else 0)
        rows.append((t, n, f, threshold, r["left"], r["right"], value, weight(t, link), r["gain"], r["rows"]))
    return spark.createDataFrame(rows, trees.NODE_TABLE)


def literal(value) -> str:
    return "NULL" if value is None else f"'{value}'" if isinstance(value, str) else f"CAST({value} AS DOUBLE)"


RULE_ROWS = ", ".join(
    f"({t}, {n}, {literal(r['feature'])}, {literal(r['offset'])}, {2 * n + 1}, {2 * n + 2}, {literal(r['value'])}, {literal(r['gain'])}, {r['rows']})"
    for t, n, r in RULE
)
STATS = " UNION ALL ".join(f"SELECT '{f}' AS feature, {i} AS pos, {f}_mean AS mean, {f}_scale AS scale FROM scales" for i, f in enumerate(FEATURES))
CELLS = " UNION ALL ".join(f"SELECT game_id, '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM complete" for f in FEATURES)

TREE_CTES = {
    **CONTRIBUTION_CTES,
    "stats": STATS,
    "cells": CELLS,
    "nodes": f"""SELECT n.*, s.mean + n.shift * s.scale AS threshold
        FROM (VALUES {RULE_ROWS}) AS n(tree, node, feature, shift, l, r, value, gain, n_rows) LEFT JOIN stats s ON s.feature = n.feature""",
    "links": "SELECT * FROM (VALUES ('mean'), ('logistic')) AS l(link)",
    # Every game walks down every tree, as it is and with one feature at its mean.
    "leaves": f"""WITH RECURSIVE walk(game_id, without, tree, node) AS (
            SELECT c.game_id, w.feature, t.tree, 0
            FROM complete c, (SELECT feature FROM stats UNION ALL SELECT NULL) AS w(feature), range({TREES}) AS t(tree)
            UNION ALL
            SELECT k.game_id, k.without, k.tree,
                CASE WHEN (CASE WHEN k.without = n.feature THEN s.mean ELSE c.value END) <= n.threshold THEN n.l ELSE n.r END
            FROM walk k JOIN nodes n ON n.tree = k.tree AND n.node = k.node
                JOIN cells c ON c.game_id = k.game_id AND c.feature = n.feature JOIN stats s ON s.feature = n.feature
        )
        SELECT k.game_id, k.without, k.tree, n.value FROM walk k JOIN nodes n ON n.tree = k.tree AND n.node = k.node WHERE n.feature IS NULL""",
    "totals": """SELECT game_id, without, link,
            CASE WHEN link = 'mean' THEN avg(value)
                ELSE 1 / (1 + exp(-2 * sum((value - 0.5) * CASE WHEN tree = 0 THEN 1.0 ELSE 0.1 END))) END AS p
        FROM leaves, links GROUP BY game_id, without, link""",
    "scored": "SELECT game_id, link AS model, p AS home_prob FROM totals WHERE without IS NULL",
    "gains": """SELECT link, feature, sum(gain / CASE WHEN link = 'mean' THEN whole ELSE 1 END) AS gain
        FROM (SELECT tree, feature, gain * n_rows AS gain, sum(gain * n_rows) OVER (PARTITION BY tree) AS whole FROM nodes WHERE gain IS NOT NULL) AS g,
            links GROUP BY link, feature""",
    "shares": """SELECT l.link AS model, s.feature, s.pos, coalesce(g.gain, 0) / sum(g.gain) OVER (PARTITION BY l.link) AS importance
        FROM stats s CROSS JOIN links l LEFT JOIN gains g ON g.link = l.link AND g.feature = s.feature""",
}


def ruled(spark, sf_dir):
    """The games, the means of their features, and the two models of the rule."""
    games = games_with_features(spark, sf_dir)
    scales = models.fit_scales(games, FEATURES)
    made = {link: trees.ensemble(node_rows(spark, scales, link), link) for link in LINKS}
    return games, {f: s.mean for f, s in scales.items()}, made


def both(frames):
    first, second = frames
    return first.unionByName(second)


@query("tree_scores", "SELECT game_id, model, home_prob FROM scored", MATCHUP_VIEWS, ["home_prob"], ctes=TREE_CTES)
def tree_scores(spark, sf_dir):
    games, _, made = ruled(spark, sf_dir)
    return both(
        trees.score(games, made[link]).select("game_id", F.lit(link).alias("model"), "home_prob") for link in LINKS
    )


@query(
    "tree_replacements",
    """SELECT w.game_id, w.link AS model, CAST(s.pos AS INT) AS pos, w.without AS feature, 100 * (b.p - w.p) AS value
       FROM totals w JOIN totals b ON b.game_id = w.game_id AND b.link = w.link AND b.without IS NULL
       JOIN stats s ON s.feature = w.without""",
    MATCHUP_VIEWS,
    ["value"],
    ctes=TREE_CTES,
)
def tree_replacements(spark, sf_dir):
    """Percentage points lost when one feature takes its mean, by the compiled trees."""
    games, means, made = ruled(spark, sf_dir)
    return both(
        models.tree_contributions(games, made[link], means, features=FEATURES).select(
            "game_id", F.lit(link).alias("model"), F.inline("contributions")
        )
        for link in LINKS
    )


@query(
    "tree_weighted_values",
    """SELECT c.game_id, s.model, CAST(s.pos AS INT) AS pos, s.feature, s.importance * c.value AS value
       FROM shares s JOIN cells c ON c.feature = s.feature""",
    MATCHUP_VIEWS,
    ["value"],
    ctes=TREE_CTES,
)
def tree_weighted_values(spark, sf_dir):
    """Importance times raw value of every feature."""
    games = games_with_features(spark, sf_dir)
    scales = models.fit_scales(games, FEATURES)

    def weighted(link):
        table = trees.importances(node_rows(spark, scales, link), link, FEATURES).collect()
        share = {r["feature"]: r["importance"] for r in table}
        rated = models.weighted_contributions(games, [share[f] for f in FEATURES], None, FEATURES)
        return rated.select("game_id", F.lit(link).alias("model"), F.inline("contributions"))

    return both(weighted(link) for link in LINKS)


IMPORTANCES = """SELECT model, feature, importance, 100 * importance AS importance_pct,
    CASE WHEN contains(feature, 'ovr') THEN 'Madden Rating'
         WHEN contains(feature, 'spread') OR contains(feature, 'total') OR contains(feature, 'implied') THEN 'Vegas Market'
         ELSE 'PBP/EPA Stats' END AS category FROM shares"""


def importance_tables(spark, sf_dir):
    scales = models.fit_scales(training(spark, sf_dir), FEATURES)
    return {link: trees.importances(node_rows(spark, scales, link), link, FEATURES) for link in LINKS}


@query("tree_importances", IMPORTANCES, MATCHUP_VIEWS, ["importance", "importance_pct"], ctes=TREE_CTES)
def tree_importances(spark, sf_dir):
    tables = importance_tables(spark, sf_dir)
    return both(t.select(F.lit(link).alias("model"), *t.columns) for link, t in tables.items())


@query(
    "tree_importance_file",
    f"SELECT feature, importance, importance_pct FROM ({IMPORTANCES}) AS i WHERE model = 'mean'",
    MATCHUP_VIEWS,
    ["importance", "importance_pct"],
    ctes=TREE_CTES,
)
def tree_importance_file(spark, sf_dir):
    """The importances of a node table written as CSV and read back."""
    table = importance_tables(spark, sf_dir)[trees.MEAN]
    path = scratch_path(spark, "importance")
    return sinks.write_results(table.select("feature", "importance", "importance_pct"), path, "csv")


# Votes as close as this to a tie may fall either way in two engines.
TIES = "abs(home_prob - 0.5) > 1e-9"


@query(
    "tree_summary",
    f"""SELECT count(*) AS games, count(*) FILTER (WHERE correct) AS correct_games, avg(CAST(correct AS INT)) AS accuracy
        FROM (SELECT CASE WHEN s.home_prob > 0.5 THEN c.home_team ELSE c.away_team END = c.winner AS correct
              FROM scored s JOIN complete c ON c.game_id = s.game_id WHERE s.model = 'logistic' AND {TIES}) AS r""",
    MATCHUP_VIEWS,
    ["accuracy"],
    ctes=TREE_CTES,
)
def tree_summary(spark, sf_dir):
    games, _, made = ruled(spark, sf_dir)
    rated = trees.score(games, made[trees.LOGISTIC]).filter(TIES)
    return models.prediction_summary(models.winners_of(rated, F.col("home_prob")))


@query(
    "tree_next_season",
    f"""SELECT game_id, season, home_team, away_team, winner, p AS predicted_home_prob,
           CASE WHEN p > 0.5 THEN home_team ELSE away_team END AS predicted_winner, greatest(p, 1 - p) AS confidence
       FROM (SELECT c.*, s.home_prob, 0.15 + 0.7 * s.home_prob AS p FROM scored s JOIN complete c ON c.game_id = s.game_id
             WHERE s.model = 'logistic' AND c.season = (SELECT max(season) FROM complete)) AS last WHERE {TIES}""",
    MATCHUP_VIEWS,
    ["predicted_home_prob", "confidence"],
    ctes=TREE_CTES,
)
def tree_next_season(spark, sf_dir):
    """The last season's games by a tree model, shrunk to the middle."""
    games, _, made = ruled(spark, sf_dir)
    last = games.agg(F.max("season").alias("season")).first()["season"]
    rated = trees.score(games.filter(F.col("season") == last), made[trees.LOGISTIC]).filter(TIES)
    return models.winners_of(rated, F.col("home_prob"), shrink=True).select(
        *KEPT, "predicted_home_prob", "predicted_winner", "confidence"
    )


@query(
    "tree_probabilities",
    """SELECT game_id, model, true AS same FROM complete, (VALUES ('Random Forest'), ('Gradient Boosting')) AS m(model)""",
    MATCHUP_VIEWS,
    ctes=CONTRIBUTION_CTES,
)
def tree_probabilities(spark, sf_dir):
    """Whether the compiled nodes of a fitted forest and a fitted boosted model give every game the
    probability that the model itself gives."""
    games = games_with_features(spark, sf_dir)

    def checked(name):
        model = models.fit_model(games, name, FEATURES)
        ours = trees.score(models.scored(games, model, "theirs"), trees.ensemble_of(model, FEATURES), "ours")
        same = F.abs(F.col("ours") - F.col("theirs")) < 1e-9
        return ours.select("game_id", F.lit(name).alias("model"), same.alias("same"))

    return settle(both(checked(name) for name in models.MODELS[1:]))
