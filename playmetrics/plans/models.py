"""Train, compare and apply the matchup models with Spark ML.

The driver holds model parameters only: sixteen means, scales, coefficients or importances.
"""

from __future__ import annotations

from collections.abc import Sequence
from multiprocessing.pool import ThreadPool
from typing import NamedTuple

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    LogisticRegressionModel,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidatorModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playmetrics.functions.codes import MATCHUP_FEATURES
from playmetrics.functions.scalars import feature_category, shrunk_probability
from playmetrics.operators.ordered import number_rows
from playmetrics.operators.relational import drop_missing
from playmetrics.operators.sizing import settle
from playmetrics.plans import trees

TARGET = "home_win"

# The three models in the order in which a tie is decided, and their settings.
MODELS = ("Logistic Regression", "Random Forest", "Gradient Boosting")
INVERSE_PENALTY = 0.5
SEED = 42

# Folds whose rows are kept in memory and fitted at a time.
FOLDS_SIDE_BY_SIDE = 3


def training_rows(matchups: DataFrame, features: Sequence[str] = MATCHUP_FEATURES) -> DataFrame:
    """Complete rows with the game, the target and the features, settled: training reads them
    many times and need not repeat the joins and aggregates behind them."""
    complete = drop_missing(matchups, [*features, TARGET])
    return settle(
        complete.select(
            "game_id", F.col(TARGET).cast("double").alias(TARGET), *[F.col(c).cast("double") for c in features]
        )
    )


# --- scaling -----------------------------------------------------------------------


class Scale(NamedTuple):
    mean: float
    deviation: float


def fit_scales(df: DataFrame, columns: Sequence[str] = MATCHUP_FEATURES) -> dict[str, Scale]:
    """Mean and population deviation per column; a constant column gets deviation 1."""
    figures = [F.avg(c).alias(f"{c}|mean") for c in columns]
    figures += [
        F.when(F.min(c) < F.max(c), F.stddev_pop(c)).otherwise(F.lit(1.0)).alias(f"{c}|scale")
        for c in columns
    ]
    row = df.agg(*figures).first()
    return {c: Scale(row[f"{c}|mean"] or 0.0, row[f"{c}|scale"] or 1.0) for c in columns}


def scaled(df: DataFrame, scales: dict[str, Scale]) -> DataFrame:
    return df.withColumns(
        {c: (F.col(c) - F.lit(s.mean)) / F.lit(s.deviation) for c, s in scales.items()}
    )


# --- models ------------------------------------------------------------------------


def model_stages(name: str, rows: int, features: Sequence[str] = MATCHUP_FEATURES) -> list:
    """The named model as stages from feature columns to predictions.

    The scaler is a stage, so each fold fits its own. Spark's scaler divides by the sample
    deviation; (n - 1) / n in the penalty makes up for that, and the fit is the one that
    population scaling and a penalty of 1 / (C n) would give.
    """
    vector = VectorAssembler(inputCols=list(features), outputCol="raw", handleInvalid="error")
    if name == "Logistic Regression":
        scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True)
        model = LogisticRegression(
            labelCol=TARGET,
            maxIter=1000,
            regParam=(rows - 1) / (INVERSE_PENALTY * rows * rows),
            elasticNetParam=0.0,
            standardization=False,
        )
        return [vector, scaler, model]
    vector = vector.setOutputCol("features")
    if name == "Random Forest":
        return [vector, RandomForestClassifier(labelCol=TARGET, numTrees=100, maxDepth=3, seed=SEED)]
    if name == "Gradient Boosting":
        return [vector, GBTClassifier(labelCol=TARGET, maxIter=50, maxDepth=2, stepSize=0.1, seed=SEED)]
    raise ValueError(f"unknown model: {name}")


def with_folds(
    df: DataFrame, folds: int | None, key: str = "game_id", most_fits: int = 1_000
) -> DataFrame:
    """Add a fold number per row, dealt in turn in key order: folds are equal to within a row.

    NULL folds give every row its own (leave-one-out). That fits a model per row, so a table of
    more than `most_fits` labelled rows is refused.
    """
    if folds is None:
        folds = df.count()
        if folds > most_fits:
            raise ValueError(f"leave-one-out would fit {folds} models; give a number of folds or raise most_fits")
    numbered = number_rows(df, "__turn", None, [key])
    return numbered.withColumn("fold", F.pmod(F.col("__turn") - 1, F.lit(folds)).cast("int")).drop("__turn")


def cross_validate(
    train: DataFrame,
    folds: int | None = 3,
    names: Sequence[str] = MODELS,
    features: Sequence[str] = MATCHUP_FEATURES,
    most_fits: int = 1_000,
) -> CrossValidatorModel:
    """Fit every model on every fold, and the most accurate one on all rows.

    The models of FOLDS_SIDE_BY_SIDE folds are fitted side by side: a fit is a long chain of short jobs, which
    alone leaves most cores idle. A tie goes to the earlier name. `most_fits` bounds the labelled rows of leave-one-out.
    """
    spark = train.sparkSession
    rows = train.count()
    folded = settle(with_folds(train, folds, most_fits=most_fits)).select(*features, TARGET, "fold")
    evaluator = MulticlassClassificationEvaluator(labelCol=TARGET, metricName="accuracy")

    def accuracies(fold: int) -> list[float]:
        kept, tried = (folded.filter(c).cache() for c in (F.col("fold") != fold, F.col("fold") == fold))

        def accuracy(name: str) -> float:
            model = Pipeline(stages=model_stages(name, rows, features)).fit(kept)
            return evaluator.evaluate(model.transform(tried))

        try:
            for what, part in (("training", kept), ("validation", tried)):
                if part.isEmpty():
                    raise ValueError(f"The {what} data at fold {fold} is empty.")
            with ThreadPool(len(names)) as pool:
                return pool.map(inheritable_thread_target(spark)(accuracy), names)
        finally:
            kept.unpersist()
            tried.unpersist()

    count = folds or rows
    with ThreadPool(FOLDS_SIDE_BY_SIDE) as pool:
        found = pool.map(inheritable_thread_target(spark)(accuracies), range(count), chunksize=1)
    means = np.mean(found, axis=0)
    best = names[int(np.argmax(means))]
    return CrossValidatorModel(Pipeline(stages=model_stages(best, rows, features)).fit(folded), list(means))


def accuracy_table(
    spark: SparkSession, validated: CrossValidatorModel, names: Sequence[str] = MODELS
) -> DataFrame:
    """Mean accuracy of each model over the folds, best first."""
    rows = [(i, n, float(a)) for i, (n, a) in enumerate(zip(names, validated.avgMetrics, strict=True))]
    table = spark.createDataFrame(rows, "place int, model string, accuracy double")
    return table.orderBy(F.col("accuracy").desc(), "place")


def fit_model(train: DataFrame, name: str, features: Sequence[str] = MATCHUP_FEATURES) -> PipelineModel:
    return Pipeline(stages=model_stages(name, train.count(), features)).fit(train)


def fit_best(
    train: DataFrame, folds: int | None = 3, features: Sequence[str] = MATCHUP_FEATURES, most_fits: int = 1_000
) -> tuple[str, PipelineModel]:
    """The most accurate model by name, fitted on all rows. `most_fits` bounds leave-one-out."""
    validated = cross_validate(train, folds, features=features, most_fits=most_fits)
    best = accuracy_table(train.sparkSession, validated).first()["model"]
    return best, validated.bestModel


def loss_slopes(
    train: DataFrame, model: PipelineModel, features: Sequence[str] = MATCHUP_FEATURES
) -> DataFrame:
    """Slope of the mean penalised loss in each weight of a fitted linear model, on values scaled by
    the population deviation: all are 0 where the fit has its optimum. One aggregate over the rows."""
    scales = fit_scales(train, features)
    line = line_of(model, features)
    error = 1 / (1 + F.exp(-line.margin())) - F.col(TARGET)
    rows = train.withColumn("__error", error)
    figures = [F.avg("__error").alias("intercept")]
    for f in features:
        scale = scales[f]
        value = (F.col(f) - F.lit(scale.mean)) / F.lit(scale.deviation)
        weight = F.lit(line.slopes[f] * scale.deviation / INVERSE_PENALTY)
        figures.append((F.avg(F.col("__error") * value) + weight / F.count(F.lit(1))).alias(f))
    row = rows.agg(*figures)
    cells = [F.struct(F.lit(c).alias("feature"), F.col(c).alias("slope")) for c in ("intercept", *features)]
    return row.select(F.inline(F.array(*cells)))


# --- importances -------------------------------------------------------------------


def feature_weights(model: PipelineModel) -> list[float]:
    """Importances of a tree model, coefficients of a linear one."""
    last = model.stages[-1]
    weights = last.featureImportances if hasattr(last, "featureImportances") else last.coefficients
    return [float(w) for w in weights.toArray()]


def importance_table(
    train: DataFrame, model: PipelineModel, features: Sequence[str] = MATCHUP_FEATURES
) -> DataFrame:
    """Feature, absolute weight, its percentage and category, most important first."""
    rows = [(i, f, abs(w)) for i, (f, w) in enumerate(zip(features, feature_weights(model), strict=True))]
    total = sum(w for _, _, w in rows) or 1.0
    table = train.sparkSession.createDataFrame(rows, "pos int, feature string, importance double")
    return (
        table.withColumns(
            {
                "importance_pct": F.col("importance") / F.lit(total) * 100,
                "category": feature_category("feature"),
            }
        )
        .orderBy(F.col("importance").desc(), "pos")
        .drop("pos")
    )


# --- scores ------------------------------------------------------------------------


def scored(df: DataFrame, model: PipelineModel, alias: str = "home_prob") -> DataFrame:
    """Add the probability of a home win."""
    made = [c for c in ("raw", "features", "rawPrediction", "probability", "prediction")]
    rated = model.transform(df)
    return rated.withColumn(alias, vector_to_array("probability")[1]).drop(*made)


def predictions(df: DataFrame, model: PipelineModel, shrink: bool = False) -> DataFrame:
    """Probabilities, predicted winner and confidence per game; `correct` where the winner is known."""
    return winners_of(scored(df, model, "__home"), F.col("__home"), shrink).drop("__home")


def winners_of(rated: DataFrame, home_prob: Column, shrink: bool = False) -> DataFrame:
    """The same for games that have their probability."""
    home = shrunk_probability(home_prob) if shrink else home_prob
    winner = F.when(F.col("predicted_home_prob") > 0.5, F.col("home_team")).otherwise(F.col("away_team"))
    result = rated.withColumn("predicted_home_prob", home).withColumns(
        {
            "predicted_away_prob": 1 - F.col("predicted_home_prob"),
            "predicted_winner": winner,
            "confidence": F.greatest("predicted_home_prob", 1 - F.col("predicted_home_prob")),
        }
    )
    if "winner" in rated.columns:
        result = result.withColumn("correct", F.col("predicted_winner") == F.col("winner"))
    return result


def prediction_summary(predicted: DataFrame) -> DataFrame:
    return predicted.agg(
        F.count(F.lit(1)).alias("games"),
        F.count_if("correct").alias("correct_games"),
        F.avg(F.col("correct").cast("double")).alias("accuracy"),
    )


def prediction_rows(
    explained: DataFrame, contributions: str = "contributions", features: Sequence[str] = MATCHUP_FEATURES
) -> DataFrame:
    """The layout of the predictions file: the game, its probabilities, and one
    `contrib_<feature>` column per feature."""
    game = [
        "season", "home_team", "away_team", F.col("winner").alias("actual_winner"),
        "predicted_home_prob", "predicted_away_prob", "predicted_winner",
        (F.col("predicted_winner") == F.col("winner")).alias("correct"), "confidence",
    ]
    parts = [F.get(contributions, F.lit(i))["value"].alias(f"contrib_{f}") for i, f in enumerate(features)]
    return explained.select(*game, *parts)


# --- contributions -----------------------------------------------------------------


def contribution_array(values: dict[str, Column]) -> Column:
    """Contributions in model order as array<struct<pos, feature, value>>."""
    return F.array(
        *[
            F.struct(F.lit(i).alias("pos"), F.lit(f).alias("feature"), v.cast("double").alias("value"))
            for i, (f, v) in enumerate(values.items())
        ]
    )


def weighted_contributions(
    df: DataFrame,
    weights: Sequence[float],
    scales: dict[str, Scale] | None = None,
    features: Sequence[str] = MATCHUP_FEATURES,
    alias: str = "contributions",
) -> DataFrame:
    """Weight times value per feature: coefficients with `scales` (scaled values), tree
    importances without (raw values)."""

    def value(f: str) -> Column:
        if scales is None:
            return F.col(f)
        return (F.col(f) - F.lit(scales[f].mean)) / F.lit(scales[f].deviation)

    parts = {f: F.lit(float(w)) * value(f) for f, w in zip(features, weights, strict=True)}
    return df.withColumn(alias, contribution_array(parts))


class Line(NamedTuple):
    """A linear model on unscaled features: the margin is `intercept` plus slope times value."""

    intercept: float
    slopes: dict[str, float]

    def margin(self) -> Column:
        return sum((F.col(f).cast("double") * F.lit(s) for f, s in self.slopes.items()), F.lit(self.intercept))


def line_of(model: PipelineModel, features: Sequence[str] = MATCHUP_FEATURES) -> Line | None:
    """The line behind a fitted linear model, its scaling worked in; None for a tree model."""
    last = model.stages[-1]
    if not isinstance(last, LogisticRegressionModel):
        return None
    scaler = model.stages[-2]
    parts = list(zip(features, last.coefficients.toArray(), scaler.mean.toArray(), scaler.std.toArray(), strict=True))
    slopes = {f: float(w / s) if s else 0.0 for f, w, _, s in parts}
    return Line(float(last.intercept) - sum(slopes[f] * float(m) for f, _, m, _ in parts), slopes)


def shifted_contributions(
    df: DataFrame, line: Line, means: dict[str, float], alias: str = "contributions"
) -> DataFrame:
    """Replacement contributions of a linear model: a replaced feature only shifts the margin,
    so each is one expression over the margin, which is worked out once."""

    def probability(margin: Column) -> Column:
        return 1 / (1 + F.exp(-margin))

    margin = F.col("__margin")
    parts = {
        f: (F.col("__base") - probability(margin + F.lit(s) * (F.lit(means[f]) - F.col(f)))) * 100
        for f, s in line.slopes.items()
    }
    based = df.withColumn("__margin", line.margin()).withColumn("__base", probability(margin))
    return based.withColumn(alias, contribution_array(parts)).drop("__margin", "__base")


def replacement_contributions(
    df: DataFrame,
    model: PipelineModel,
    means: dict[str, float],
    alias: str = "contributions",
    features: Sequence[str] = MATCHUP_FEATURES,
) -> DataFrame:
    """Percentage points the home probability loses when one feature takes its training mean.

    A linear model's margin is shifted. A tree model is compiled to one expression, and a replaced feature reads only
    the trees that split on it again. No rows are multiplied and nothing is shuffled.
    """
    line = line_of(model, features)
    if line is not None:
        return shifted_contributions(df, line, means, alias)
    return tree_contributions(df, trees.ensemble_of(model, features), means, alias, features)


def tree_contributions(
    df: DataFrame,
    ensemble: trees.Ensemble,
    means: dict[str, float],
    alias: str = "contributions",
    features: Sequence[str] = MATCHUP_FEATURES,
) -> DataFrame:
    """The same for compiled trees."""
    names = {f: f"__without_{f}" for f in features}
    rows = trees.replaced(df, ensemble, means, "__base", names)
    parts = {f: (F.col("__base") - F.col(name)) * 100 for f, name in names.items()}
    return rows.withColumn(alias, contribution_array(parts)).drop("__base", *names.values())
