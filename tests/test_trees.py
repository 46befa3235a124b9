"""Node tables and compiled trees against the fitted models and a walk by hand."""

import random

import pytest

from playmetrics.plans import models as M
from playmetrics.plans import trees as T

FEATURES = ["edge", "noise", "third", "flat"]
NAMES = ["Random Forest", "Gradient Boosting"]


@pytest.fixture(scope="module")
def train(spark):
    rng = random.Random(8)
    rows = []
    for i in range(120):
        edge, noise, third = rng.uniform(-1, 1), rng.choice([0.0, 1.0, 2.0]), rng.gauss(0, 1)
        rows.append((i, float(edge + 0.3 * third + rng.gauss(0, 0.3) > 0), edge, noise, third, 3.0))
    columns = "game_id long, home_win double, edge double, noise double, third double, flat double"
    return spark.createDataFrame(rows, columns).repartition(1).cache()


@pytest.fixture(scope="module", params=NAMES)
def model(request, train):
    return M.fit_model(train, request.param, FEATURES)


def test_compiled_scores_equal_the_models(train, model):
    rated = T.score(M.scored(train, model, "theirs"), T.ensemble_of(model, FEATURES), "ours")
    rows = rated.select("theirs", "ours").collect()
    assert len(rows) == 120
    assert [r["ours"] for r in rows] == pytest.approx([r["theirs"] for r in rows], abs=1e-12)


def test_importances_equal_the_models(train, model):
    table = T.importances(T.node_table(model, FEATURES), T.link_of(model), FEATURES).collect()
    theirs = dict(zip(FEATURES, M.feature_weights(model), strict=True))
    assert {r["feature"]: r["importance"] for r in table} == pytest.approx(theirs, abs=1e-9)
    assert [r["importance"] for r in table] == sorted((r["importance"] for r in table), reverse=True)


def test_replacement_equals_scoring_changed_rows(train, model):
    means = {f: s.mean for f, s in M.fit_scales(train, FEATURES).items()}
    rows = M.replacement_contributions(train, model, means, features=FEATURES)
    assert rows.columns == [*train.columns, "contributions"]
    got = {r["game_id"]: r["contributions"] for r in rows.collect()}
    base = {r["game_id"]: r["p"] for r in M.scored(train, model, "p").collect()}
    for pos, f in enumerate(FEATURES):
        changed = M.scored(train.withColumn(f, M.F.lit(means[f])), model, "p").collect()
        for r in changed:
            part = got[r["game_id"]][pos]
            assert (part["pos"], part["feature"]) == (pos, f)
            assert part["value"] == pytest.approx(100 * (base[r["game_id"]] - r["p"]), abs=1e-9)


def by_hand(tree, row, at=0):
    node = tree[at]
    if node.feature is None:
        return node.value
    return by_hand(tree, row, node.left if row[node.feature] <= node.threshold else node.right)


def test_node_tables_from_anywhere(spark):
    nodes = [
        (0, 0, "edge", 0.0, 1, 2, None, 1.0, 0.5, 10), (0, 1, None, None, None, None, 0.25, 1.0, None, 4),
        (0, 2, "noise", 1e-7, 3, 4, None, 1.0, 0.25, 6), (0, 3, None, None, None, None, 0.5, 1.0, None, 3),
        (0, 4, None, None, None, None, -2.0, 1.0, None, 3), (3, 0, None, None, None, None, 0.75, 0.5, None, 10),
    ]
    table = spark.createDataFrame(nodes, T.NODE_TABLE)
    rows = [(-1.0, 5.0), (0.0, 5.0), (1.0, 0.0), (1.0, 1.0), (float("nan"), float("nan"))]
    df = spark.createDataFrame(rows, "edge double, noise double")
    for link in (T.MEAN, T.LOGISTIC):
        model = T.ensemble(table, link)
        assert model.weights == [1.0, 0.5]
        got = [r["p"] for r in T.score(df, model, "p").collect()]
        for row, p in zip(rows, got, strict=True):
            total = sum(w * by_hand(t, dict(zip(("edge", "noise"), row, strict=True))) for t, w in zip(model.trees, model.weights, strict=True))
            want = total / 1.5 if link == T.MEAN else 1 / (1 + 2.718281828459045 ** (-2 * total))
            assert p == pytest.approx(want, abs=1e-12)
    assert T.tree_text(model.trees[0], 1.0, {"edge": -1.0}) == "0.25D"
    assert "edge" not in T.tree_text(model.trees[0], 1.0, {"edge": 1.0})


def test_a_tree_without_splits(spark):
    table = spark.createDataFrame([(0, 0, None, None, None, None, 0.5, 1.0, None, 9)], T.NODE_TABLE)
    parts = T.importances(table, T.MEAN, FEATURES).collect()
    assert [r["feature"] for r in parts] == FEATURES and {r["importance"] for r in parts} == {0.0}


def test_too_many_nodes(spark, monkeypatch):
    monkeypatch.setattr(T, "MOST_NODES", 2)
    table = spark.createDataFrame([(0, i, None, None, None, None, 0.5, 1.0, None, 9) for i in range(3)], T.NODE_TABLE)
    with pytest.raises(ValueError):
        T.ensemble(table, T.MEAN)
