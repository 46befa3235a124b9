"""Tree models as node tables, and node tables as column expressions.

A node table has one row per node: tree, node, feature, threshold, left, right, value, weight, gain, rows.
It comes from a fitted model or from anywhere else. Tables of all sizes can be joined and aggregated; the trees that
are compiled are bounded by `MOST_NODES`, and become nested CASE expressions: a score is one
projection, without Python and without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import NamedTuple

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, RandomForestClassificationModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playmetrics.functions.codes import MATCHUP_FEATURES
from playmetrics.functions.scalars import feature_category
from playmetrics.operators.sizing import scratch_path

MOST_NODES = 100_000
NODE_TABLE = (
    "tree int, node int, feature string, threshold double, left int, right int, value double, weight double, "
    "gain double, rows long"
)

# How a sum over trees becomes a probability: a weighted mean of leaf shares, or twice the margin's logistic.
MEAN, LOGISTIC = "mean", "logistic"


class Node(NamedTuple):
    feature: str | None
    threshold: float | None
    left: int | None
    right: int | None
    value: float


class Ensemble(NamedTuple):
    """Trees as {node: Node}, node 0 the root, with a weight each."""

    trees: list[dict[int, Node]]
    weights: list[float]
    link: str

    def probability(self, total: Column) -> Column:
        if self.link == LOGISTIC:
            return 1 / (1 + F.exp(-2 * total))
        return total / F.lit(sum(self.weights))


def is_tree_model(model: PipelineModel) -> bool:
    return isinstance(model.stages[-1], RandomForestClassificationModel | GBTClassificationModel)


def link_of(model: PipelineModel) -> str:
    return LOGISTIC if isinstance(model.stages[-1], GBTClassificationModel) else MEAN


def node_table(model: PipelineModel, features: Sequence[str] = MATCHUP_FEATURES) -> DataFrame:
    """The nodes of a fitted forest or boosted model, from the table that saving it writes to the shared folder.

    `value` is the share of wins in a forest's node and the fitted step in a boosted one; leaves have no
    feature. Features are taken as numbers: the models have no categories.
    """
    last = model.stages[-1]
    spark = SparkSession.getActiveSession()
    path = scratch_path(spark, "trees")
    last.write().save(path)
    data, weights = spark.read.parquet(f"{path}/data"), spark.read.parquet(f"{path}/treesMetadata")
    names = F.array(*[F.lit(f) for f in features])
    stats, split = F.col("nodeData.impurityStats"), F.col("nodeData.split")
    inner = F.col("nodeData.leftChild") >= 0
    value, weight = F.col("nodeData.prediction"), F.col("weight")
    if link_of(model) == MEAN:
        # A forest's tree whose sample came out empty has no say.
        seen = F.aggregate(stats, F.lit(0.0), lambda s, x: s + x)
        value, weight = F.when(seen > 0, stats[1] / seen).otherwise(0.0), F.when(F.col("__seen") > 0, weight).otherwise(0.0)
        data = data.withColumn("__seen", seen)
    # A weight per tree: far fewer rows than nodes.
    named = weights.select(F.col("_1").alias("treeID"), F.col("_3").alias("weight"))
    return data.join(named, "treeID").select(
        F.col("treeID").alias("tree"), F.col("nodeData.id").alias("node"),
        F.when(inner, F.get(names, split["featureIndex"])).alias("feature"),
        F.when(inner, F.get(split["leftCategoriesOrThreshold"], F.lit(0))).alias("threshold"),
        F.when(inner, F.col("nodeData.leftChild")).alias("left"), F.when(inner, F.col("nodeData.rightChild")).alias("right"),
        value.alias("value"), weight.alias("weight"), F.when(inner, F.col("nodeData.gain")).alias("gain"),
        F.col("nodeData.rawCount").alias("rows"),
    )


def ensemble(nodes: DataFrame, link: str) -> Ensemble:
    """The trees of a node table, checked against `MOST_NODES`."""
    rows = nodes.limit(MOST_NODES + 1).collect()
    if len(rows) > MOST_NODES:
        raise ValueError(f"more than {MOST_NODES} nodes")
    trees: dict[int, dict[int, Node]] = {}
    weights: dict[int, float] = {}
    for r in rows:
        trees.setdefault(r["tree"], {})[r["node"]] = Node(r["feature"], r["threshold"], r["left"], r["right"], r["value"])
        weights[r["tree"]] = r["weight"]
    order = sorted(trees)
    return Ensemble([trees[t] for t in order], [weights[t] for t in order], link)


def ensemble_of(model: PipelineModel, features: Sequence[str] = MATCHUP_FEATURES) -> Ensemble:
    return ensemble(node_table(model, features), link_of(model))


# --- Compilation -------------------------------------------------------------------------------------


def number(value: float) -> str:
    return f"CAST('{value!r}' AS DOUBLE)" if value != value or value in (float("inf"), float("-inf")) else f"{value!r}D"


def tree_text(tree: dict[int, Node], weight: float, fixed: dict[str, float], at: int = 0) -> str:
    """SQL of a tree's weighted value. A feature with a fixed value takes its branch here already, so only
    the paths that remain are written; a split with equal sides is left out."""
    node = tree[at]
    if node.feature is None:
        return number(node.value * weight)
    if node.feature in fixed:
        return tree_text(tree, weight, fixed, node.left if fixed[node.feature] <= node.threshold else node.right)
    left, right = (tree_text(tree, weight, fixed, side) for side in (node.left, node.right))
    if left == right:
        return left
    return f"CASE WHEN `{node.feature}` <= {number(node.threshold)} THEN {left} ELSE {right} END"


def added(texts: Iterable[str]) -> str:
    """The sum of many terms, as an array: its terms are compiled in methods of their own."""
    return f"aggregate(array({', '.join(texts)}), 0D, (s, x) -> s + x)"


def score(df: DataFrame, model: Ensemble, alias: str = "home_prob") -> DataFrame:
    """Add the probability, in one projection. Features have to be numbers and known; NaN goes to the right."""
    texts = [tree_text(t, w, {}) for t, w in zip(model.trees, model.weights, strict=True)]
    return df.withColumn(alias, model.probability(F.expr(added(texts)) if texts else F.lit(0.0)))


def used(tree: dict[int, Node]) -> set[str]:
    return {n.feature for n in tree.values() if n.feature is not None}


def replaced(
    df: DataFrame, model: Ensemble, means: dict[str, float], base: str, without: dict[str, str]
) -> DataFrame:
    """Add the probability as `base` and, per feature, under the name in `without`, the probability with the
    feature at its mean.

    The value of each tree is worked out once. A replaced feature changes only the trees that split on it, and of
    those only the paths left are read again.
    """
    texts = [tree_text(t, w, {}) for t, w in zip(model.trees, model.weights, strict=True)]
    rows = df.withColumn("__trees", F.expr(f"array({', '.join(texts)})"))
    rows = rows.withColumn("__total", F.expr("aggregate(__trees, 0D, (s, x) -> s + x)"))
    columns = {base: model.probability(F.col("__total"))}
    for feature, name in without.items():
        changes = [
            f"{tree_text(t, w, {feature: means[feature]})} - __trees[{k}]"
            for k, (t, w) in enumerate(zip(model.trees, model.weights, strict=True))
            if feature in used(t)
        ]
        total = F.col("__total") + F.expr(added(changes)) if changes else F.col("__total")
        columns[name] = model.probability(total)
    return rows.withColumns(columns).drop("__trees", "__total")


# --- Figures of a node table ------------------------------------------------------------------------


def importances(nodes: DataFrame, link: str, features: Sequence[str] = MATCHUP_FEATURES) -> DataFrame:
    """Per feature its share of the gain, counted by rows: feature, importance, importance_pct, category, most
    important first, ties in the order of the features.

    A forest's trees count alike, whatever their gains; a boosted model's gains are added as they are.
    """
    spark = nodes.sparkSession
    gains = nodes.filter("feature IS NOT NULL").groupBy("tree", "feature").agg(F.sum(F.col("gain") * F.col("rows")).alias("gain"))
    if link == MEAN:
        whole = gains.groupBy("tree").agg(F.sum("gain").alias("whole")).filter("whole <> 0")
        gains = gains.join(whole, "tree").withColumn("gain", F.col("gain") / F.col("whole"))
    parts = gains.groupBy("feature").agg(F.sum("gain").alias("gain"))
    # One row per feature of the model.
    names = spark.createDataFrame(list(enumerate(features)), "pos int, feature string")
    listed = names.join(parts, "feature", "left").withColumn("gain", F.coalesce("gain", F.lit(0.0)))
    total = listed.agg(F.sum("gain").alias("total")).select("total").scalar()
    share = F.when(total != 0, F.col("gain") / total).otherwise(0.0)
    table = listed.select("pos", "feature", share.alias("importance"))
    return (
        table.withColumns({"importance_pct": F.col("importance") * 100, "category": feature_category("feature")})
        .orderBy(F.col("importance").desc(), "pos")
        .drop("pos")
    )
