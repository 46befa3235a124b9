import random
import statistics
import threading

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import functions as F
from pyspark.sql import types as T

from playmetrics.plans import models as M
from playmetrics.sources import schemas

FEATURES = ["edge", "noise", "flat"]


def rows(n=60):
    rng = random.Random(5)
    made = []
    for i in range(n):
        edge = rng.uniform(-1, 1)
        won = edge + rng.gauss(0, 0.3) > 0
        made.append((i, "H", "A", "H" if won else "A", float(won), edge, rng.uniform(-1, 1), 3.0))
    return made


@pytest.fixture(scope="module")
def train(spark):
    columns = (
        "game_id long, home_team string, away_team string, winner string, home_win double, "
        "edge double, noise double, flat double"
    )
    return spark.createDataFrame(rows(), columns).repartition(1).cache()


@pytest.fixture(scope="module")
def linear(train):
    return M.fit_model(train, "Logistic Regression", FEATURES)


def test_scales(train):
    scales = M.fit_scales(train, FEATURES)
    edges = [r[5] for r in rows()]
    assert scales["edge"].mean == pytest.approx(statistics.fmean(edges))
    assert scales["edge"].deviation == pytest.approx(statistics.pstdev(edges))
    assert scales["flat"] == (3.0, 1.0)
    got = M.scaled(train, scales).agg(F.avg("edge"), F.stddev_pop("edge"), F.max("flat")).first()
    assert tuple(got) == pytest.approx((0.0, 1.0, 0.0), abs=1e-9)


def test_linear_fit_minimises_the_penalised_loss(train, linear):
    """The fit equals minimising sum(log loss) + |w|^2 / (2 C) on population-scaled values."""
    numpy = pytest.importorskip("numpy")
    data = numpy.array([[r[5], r[6], r[7]] for r in rows()])
    y = numpy.array([r[4] for r in rows()])
    spread = data.std(axis=0)
    z = (data - data.mean(axis=0)) / numpy.where(spread > 0, spread, 1)
    w, b = numpy.zeros(3), 0.0
    for _ in range(20000):
        p = 1 / (1 + numpy.exp(-(z @ w + b)))
        w -= 0.01 * (z.T @ (p - y) + w / M.INVERSE_PENALTY)
        b -= 0.01 * (p - y).sum()
    probabilities = {
        r["game_id"]: r["p"]
        for r in linear.transform(train).select("game_id", vector_to_array("probability")[1].alias("p")).collect()
    }
    expected = 1 / (1 + numpy.exp(-(z @ w + b)))
    assert [probabilities[i] for i in range(60)] == pytest.approx(list(expected), abs=1e-3)


def test_signs_and_importances(train, linear):
    weights = M.feature_weights(linear)
    assert weights[0] > abs(weights[1]) and weights[2] == 0
    table = M.importance_table(train, linear, FEATURES).collect()
    assert [r["feature"] for r in table][0] == "edge"
    assert sum(r["importance_pct"] for r in table) == pytest.approx(100)
    assert [r["importance"] for r in table] == sorted((r["importance"] for r in table), reverse=True)


@pytest.mark.parametrize("name", ["Random Forest", "Gradient Boosting"])
def test_trees_repeat(train, name):
    first, second = (M.feature_weights(M.fit_model(train, name, FEATURES)) for _ in range(2))
    assert first == second and first[0] == max(first)


def test_unknown_model():
    with pytest.raises(ValueError, match="unknown model"):
        M.model_stages("Oracle", 10, FEATURES)


def test_predictions_are_consistent(train, linear):
    got = M.predictions(train, linear).collect()
    for r in got:
        assert r["predicted_home_prob"] + r["predicted_away_prob"] == pytest.approx(1)
        assert r["confidence"] == max(r["predicted_home_prob"], r["predicted_away_prob"])
        assert r["predicted_winner"] == ("H" if r["predicted_home_prob"] > 0.5 else "A")
        assert r["correct"] == (r["predicted_winner"] == r["winner"])
    summary = M.prediction_summary(M.predictions(train, linear)).first()
    assert summary["games"] == 60 and summary["correct_games"] == sum(r["correct"] for r in got)
    assert summary["accuracy"] == pytest.approx(summary["correct_games"] / 60) and summary["accuracy"] > 0.8


def test_shrunk_predictions_stay_in_range(train, linear):
    got = M.predictions(train, linear, shrink=True).select("predicted_home_prob").collect()
    assert all(0.15 <= r[0] <= 0.85 for r in got)


def test_weighted_contributions(train):
    scales = M.fit_scales(train, FEATURES)
    raw = M.weighted_contributions(train, [2.0, 0.0, 1.0], None, FEATURES).orderBy("game_id").first()
    assert [(c["pos"], c["feature"]) for c in raw["contributions"]] == list(enumerate(FEATURES))
    assert [c["value"] for c in raw["contributions"]] == pytest.approx([2 * raw["edge"], 0.0, 3.0])
    scaled = M.weighted_contributions(train, [2.0, 0.0, 1.0], scales, FEATURES).orderBy("game_id").first()
    expected = 2 * (raw["edge"] - scales["edge"].mean) / scales["edge"].deviation
    assert scaled["contributions"][0]["value"] == pytest.approx(expected)
    assert scaled["contributions"][2]["value"] == pytest.approx(0.0)


@pytest.mark.parametrize("name", ["Logistic Regression", "Random Forest"])
def test_replacement_contributions(train, name):
    linear = M.fit_model(train, name, FEATURES)
    means = {f: s.mean for f, s in M.fit_scales(train, FEATURES).items()}
    got = M.replacement_contributions(train, linear, means, features=FEATURES)
    assert got.columns == [*train.columns, "contributions"]
    row = got.orderBy("game_id").first()
    replaced = train.filter("game_id = 0").withColumn("edge", F.lit(means["edge"]))
    base = M.scored(train.filter("game_id = 0"), linear).first()["home_prob"]
    without = M.scored(replaced, linear).first()["home_prob"]
    assert row["contributions"][0]["value"] == pytest.approx(100 * (base - without))
    assert row["contributions"][2]["value"] == pytest.approx(0.0)
    assert row["edge"] == train.filter("game_id = 0").first()["edge"]


def test_folds(spark, train):
    dealt = M.with_folds(train, 7).groupBy("fold").count().collect()
    assert sorted(r["fold"] for r in dealt) == list(range(7)) and {r["count"] for r in dealt} == {8, 9}
    assert M.with_folds(train, None).select("fold").distinct().count() == 60
    with pytest.raises(ValueError, match="leave-one-out"):
        M.with_folds(train, None, most_fits=10)
    for n in (1_000, 1_001, 30_000):
        games = spark.range(n).withColumnRenamed("id", "game_id").repartition(5)
        got = M.with_folds(games, 3).filter("game_id < 6").orderBy("game_id").collect()
        assert [r["fold"] for r in got] == [0, 1, 2, 0, 1, 2]


def test_fit_best(train):
    name, model = M.fit_best(train.filter("game_id < 40"), 4, FEATURES)
    assert name in M.MODELS and M.scored(train, model).filter("home_prob between 0 and 1").count() == 60


def test_leave_one_out_comparison(spark, train):
    few = train.filter("game_id < 12")
    validated = M.cross_validate(few, None, ["Logistic Regression", "Random Forest"], FEATURES)
    table = M.accuracy_table(spark, validated, ["Logistic Regression", "Random Forest"]).collect()
    assert [r["accuracy"] for r in table] == sorted((r["accuracy"] for r in table), reverse=True)
    assert all((r["accuracy"] * 12) == pytest.approx(round(r["accuracy"] * 12)) for r in table)


def test_folds_fit_side_by_side(train, monkeypatch):
    """Three folds are under way at once, and the means are those of Spark's own validator."""
    names, stages = M.MODELS[:2], M.model_stages
    meeting, met = threading.Barrier(6, timeout=120), []

    def together(*given):
        if threading.current_thread() is not threading.main_thread():
            met.append(meeting.wait())
        return stages(*given)

    monkeypatch.setattr(M, "model_stages", together)
    got = M.cross_validate(train, 3, names, FEATURES)
    assert sorted(met) == list(range(6))
    pipeline = Pipeline(stages=[])
    theirs = CrossValidator(
        estimator=pipeline,
        estimatorParamMaps=[{pipeline.stages: stages(n, 60, FEATURES)} for n in names],
        evaluator=MulticlassClassificationEvaluator(labelCol=M.TARGET, metricName="accuracy"),
        numFolds=3,
        foldCol="fold",
    ).fit(M.settle(M.with_folds(train, 3)))
    assert got.avgMetrics == pytest.approx(theirs.avgMetrics)
    ours, expected = (M.scored(train, m.bestModel).orderBy("game_id").collect() for m in (got, theirs))
    assert [r["home_prob"] for r in ours] == pytest.approx([r["home_prob"] for r in expected])


def test_fold_without_rows(train):
    with pytest.raises(ValueError, match="is empty"):
        M.cross_validate(train.filter("game_id < 2"), 3, M.MODELS[:1], FEATURES)


def test_prediction_file_layout(spark, train, linear):
    means = {f: s.mean for f, s in M.fit_scales(train, FEATURES).items()}
    games = M.predictions(train.withColumn("season", F.lit(2001)), linear)
    explained = M.replacement_contributions(games, linear, means, features=FEATURES)
    got = M.prediction_rows(explained, features=FEATURES)
    assert got.columns[-3:] == ["contrib_edge", "contrib_noise", "contrib_flat"]
    first = explained.select("contributions").first()[0]
    assert tuple(got.first())[-3:] == tuple(c["value"] for c in first)
    known = T._parse_datatype_string(schemas.PREDICTIONS)
    assert len(known) == 25 and got.columns[:9] == known.names[:9]
