"""Held-out predictions of the linear model: all folds fitted side by side.

A fold's model is fitted on the whole table without the fold's rows. One job per Newton step sums, for
every fold at once, the slopes and second derivatives of the loss over the rows outside the fold; a
task multiplies its rows with the weights of all folds as one matrix. Means and deviations outside a
fold are those of the whole minus the fold's, from one aggregate. The driver holds the weights and
solves one small system per fold, so the number of folds is bounded (`most_fits`).

Leave-one-out has a fold per row, and sums over all rows for each of them would grow with the square of
the table. Beyond `DIRECT_FITS` rows every fold's model is found next to the model of all rows: sums of
the second to the fourth derivatives of the loss there, taken once, give the slope at any weights near it,
less the slope of the row itself. A bound on what the higher derivatives can add is worked out for every
row. Rows whose margin is not settled by it to `MARGIN_ERROR`, those with a large pull on the model, are
fitted with sums over all rows like the folds of a small table, some at a time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playmetrics.functions.codes import MATCHUP_FEATURES
from playmetrics.operators.sizing import scratch_path, settle
from playmetrics.plans.models import INVERSE_PENALTY, TARGET, fit_scales, scaled, with_folds

STEPS = 50
STEP_SIZE = 1e-10
# Rows and folds that a task multiplies at a time, and rows that are worth a task.
ROWS_AT_ONCE, FOLDS_AT_ONCE, TASK_ROWS = 1_024, 256, 20_000
# Folds that the driver holds the weights of: the most that can be asked for, and those of rows left out one by one.
MOST_FITS, DIRECT_FITS = 20_000, 4_096
# Expansions: how far a margin may be off by its bound, the largest pull of a row and change of a margin for which the
# bound holds, and the rounds and the last step, in the margin, of solving.
MARGIN_ERROR, MOST_PULL, MOST_CHANGE = 1e-9, 0.5, 0.1
ROUNDS, LAST_STEP = 60, 1e-12
PARTS = "first int, sums binary"


class FoldFits(NamedTuple):
    """Weights per fold on values scaled over all rows; the last column is the intercept. `certain` is the
    outcome of folds whose other rows all have the same one, else NaN."""

    weights: np.ndarray
    certain: np.ndarray


def figures(features: Sequence[str]) -> Column:
    """Rows, wins, sums and sums of squares as one array."""
    found = [F.count(F.lit(1)).cast("double"), F.sum(TARGET), *[F.sum(f) for f in features]]
    return F.array(*found, *[F.sum(F.col(f) * F.col(f)) for f in features])


def by_name(outside: np.ndarray) -> dict[str, np.ndarray]:
    """The columns of rows of `figures`."""
    d = (outside.shape[1] - 2) // 2
    return {"n": outside[:, 0], "wins": outside[:, 1], "sums": outside[:, 2 : 2 + d], "squares": outside[:, 2 + d :]}


def fold_sums(rows: DataFrame, folds: int, features: Sequence[str]) -> dict[str, np.ndarray]:
    """Rows, wins, sums and sums of squares outside each fold: the whole minus the fold."""
    inside = np.zeros((folds, 2 + 2 * len(features)))
    for row in rows.groupBy("fold").agg(figures(features).alias("s")).collect():
        inside[row["fold"]] = row["s"]
    return by_name(inside.sum(axis=0) - inside)


def sums_without(whole: np.ndarray, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """The same outside each of some rows, from the figures of the whole table."""
    return by_name(whole - np.column_stack([np.ones(len(y)), y, x, x * x]))


def penalties(sums: dict[str, np.ndarray]) -> np.ndarray:
    """Penalty per weight of each fold's model, none on the intercept."""
    return np.concatenate([fold_deviations(sums) ** 2 / INVERSE_PENALTY, np.zeros((len(sums["n"]), 1))], axis=1)


def certain_outcomes(sums: dict[str, np.ndarray]) -> np.ndarray:
    """The outcome of folds whose other rows all have the same one, else NaN."""
    share = sums["wins"] / np.maximum(sums["n"], 1)
    return np.where((share == 0) | (share == 1), share, np.nan)


def fold_deviations(sums: dict[str, np.ndarray]) -> np.ndarray:
    """Population deviation of each feature outside each fold; 1 where the feature is constant there."""
    n = np.maximum(sums["n"], 1)[:, None]
    means = sums["sums"] / n
    spread = sums["squares"] / n - means * means
    return np.sqrt(np.where(spread > 1e-12 * np.maximum(1, means * means), spread, 1.0))


def matrix(batch: pa.RecordBatch, features: Sequence[str]) -> np.ndarray:
    """The values of a batch with a column of ones for the intercept."""
    return np.stack([*(np.asarray(batch.column(f)) for f in features), np.ones(batch.num_rows)], axis=1)


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, rows):
            yield whole.slice(start, rows)


def part(first: int, sums: np.ndarray) -> pa.RecordBatch:
    """One task's sums as a row of PARTS."""
    return pa.RecordBatch.from_pydict({"first": pa.array([first], pa.int32()), "sums": pa.array([sums.tobytes()], pa.binary())})


def added(parts: DataFrame) -> dict[int, np.ndarray]:
    """The sums of all tasks, by `first`."""

    def add(group: pa.Table) -> pa.Table:
        found = [np.frombuffer(x, float) for x in group.column("sums").to_pylist()]
        return pa.table({"first": group.column("first").slice(0, 1), "sums": pa.array([sum(found).tobytes()], pa.binary())})

    rows = parts.groupBy("first").applyInArrow(add, PARTS).collect()
    return {row["first"]: np.frombuffer(bytes(row["sums"]), float) for row in rows}


def slope_sums(
    rows: DataFrame, weights: np.ndarray, features: Sequence[str], left: np.ndarray | None
) -> tuple[np.ndarray, np.ndarray]:
    """Sums of slopes and of second derivatives of the loss for every fold's weights, each over the rows
    outside the fold. `left` has the fold numbers in ascending order; NULL leaves nothing out."""
    k, d = weights.shape
    upper = np.triu_indices(d)
    width = d + len(upper[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, width))
        for batch in slices(batches, ROWS_AT_ONCE):
            x, y = matrix(batch, features), np.asarray(batch.column(TARGET))
            products = x[:, upper[0]] * x[:, upper[1]]
            if left is not None:
                fold = np.asarray(batch.column("fold"))
                place = np.minimum(np.searchsorted(left, fold), k - 1)
                place[left[place] != fold] = -1
            for first in range(0, k, FOLDS_AT_ONCE):
                some = slice(first, min(k, first + FOLDS_AT_ONCE))
                p = 0.5 * (1 + np.tanh(0.5 * (x @ weights[some].T)))
                error, curve = p - y[:, None], p * (1 - p)
                if left is not None:
                    own = np.flatnonzero((place >= some.start) & (place < some.stop))
                    error[own, place[own] - first] = 0
                    curve[own, place[own] - first] = 0
                total[some, :d] += error.T @ x
                total[some, d:] += curve.T @ products
        for first in range(0, k, FOLDS_AT_ONCE):
            yield part(first, total[first : first + FOLDS_AT_ONCE])

    sums = np.zeros((k, width))
    for first, found in added(rows.select(*features, TARGET, "fold").mapInArrow(run, PARTS)).items():
        found = found.reshape(-1, width)
        sums[first : first + len(found)] = found
    return sums[:, :d], symmetric(sums[:, d:], d)


def symmetric(halves: np.ndarray, d: int) -> np.ndarray:
    """Matrices from their upper halves."""
    full = np.zeros((*halves.shape[:-1], d, d))
    a, b = np.triu_indices(d)
    full[..., a, b] = full[..., b, a] = halves
    return full


def newton(
    rows: DataFrame, weights: np.ndarray, penalty: np.ndarray, moving: np.ndarray, features: Sequence[str],
    left: np.ndarray | None,
) -> np.ndarray:
    """Weights at which the penalised loss of every moving fold has no slope left. Steps longer than 2 in a
    weight are shortened."""
    weights = weights.copy()
    for _ in range(STEPS):
        if not moving.any():
            break
        slopes, curves = slope_sums(rows, weights[moving], features, None if left is None else left[moving])
        slopes = slopes + penalty[moving] * weights[moving]
        curves = curves + np.einsum("ij,jk->ijk", penalty[moving], np.eye(weights.shape[1]))
        step = np.linalg.solve(curves, slopes[:, :, None])[:, :, 0]
        longest = np.abs(step).max(axis=1)
        step *= np.minimum(1, 2 / np.maximum(longest, 1e-300))[:, None]
        weights[moving] -= step
        moving = moving.copy()
        moving[np.flatnonzero(moving)[longest < STEP_SIZE]] = False
    return weights


def fit_whole(folded: DataFrame, features: Sequence[str]) -> np.ndarray:
    """The weights fitted on all rows, as one row."""
    d = len(features) + 1
    penalty = np.array([[1 / INVERSE_PENALTY] * (d - 1) + [0.0]])
    return newton(folded, np.zeros((1, d)), penalty, np.array([True]), features, None)


def fit_folds(folded: DataFrame, folds: int, features: Sequence[str] = MATCHUP_FEATURES) -> FoldFits:
    """Fit the penalised logistic regression of `models` on the rows outside each fold.

    `folded` has the features scaled over all rows, the target and a fold number below `folds`.
    """
    sums = fold_sums(folded, folds, features)
    certain = certain_outcomes(sums)
    open_folds = np.isnan(certain)
    whole = fit_whole(folded, features) if open_folds.any() else np.zeros((1, len(features) + 1))
    weights = newton(folded, np.repeat(whole, folds, axis=0), penalties(sums), open_folds, features, np.arange(folds))
    return FoldFits(weights, certain)


class Expansion(NamedTuple):
    """The loss over all rows around `weights`: its slopes, and sums over the rows of its second derivative times the
    products of two values, of its third times three, and of its fourth times four. Two values are a pair of columns,
    the upper half of a symmetric matrix."""

    weights: np.ndarray
    slopes: np.ndarray
    second: np.ndarray
    third: np.ndarray
    fourth: np.ndarray

    def slopes_at(self, change: np.ndarray) -> np.ndarray:
        """Slopes at the weights changed by each row of `change`, up to the fourth derivative."""
        d = len(self.weights)
        a, b = np.triu_indices(d)
        squares = change[:, a] * change[:, b] * np.where(a == b, 1.0, 2.0)
        fourth = np.einsum("kij,kj->ki", symmetric(squares @ self.fourth, d), change)
        return self.slopes + change @ symmetric(self.second, d) + squares @ self.third.T / 2 + fourth / 6


def expand(rows: DataFrame, weights: np.ndarray, features: Sequence[str]) -> Expansion:
    d = len(weights)
    upper = np.triu_indices(d)
    n = len(upper[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(d), np.zeros(n), np.zeros((d, n)), np.zeros((n, n))]
        for batch in slices(batches, ROWS_AT_ONCE):
            x = matrix(batch, features)
            pairs = x[:, upper[0]] * x[:, upper[1]]
            p = 0.5 * (1 + np.tanh(0.5 * (x @ weights)))
            curve = p * (1 - p)
            total[0] += (p - np.asarray(batch.column(TARGET))) @ x
            total[1] += curve @ pairs
            total[2] += (x * (curve * (1 - 2 * p))[:, None]).T @ pairs
            total[3] += (pairs * (curve * (1 - 6 * curve))[:, None]).T @ pairs
        yield part(0, np.concatenate([t.ravel() for t in total]))

    sums = added(rows.select(*features, TARGET).mapInArrow(run, PARTS))[0]
    slopes, second, third, fourth = np.split(sums, np.cumsum([d, n, d * n]))
    return Expansion(weights, slopes, second, third.reshape(d, n), fourth.reshape(n, n))


def largest_reach(rows: DataFrame, inverse: np.ndarray, features: Sequence[str]) -> float:
    """The largest length of a row's values in the metric of the inverse of the second derivatives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = 0.0
        for batch in slices(batches, ROWS_AT_ONCE):
            x = matrix(batch, features)
            most = max(most, float(((x @ inverse) * x).sum(axis=1).max()))
        yield pa.RecordBatch.from_pydict({"most": pa.array([most], pa.float64())})

    found = rows.select(*features).mapInArrow(run, "most double").agg(F.max("most").alias("most")).first()
    return float(np.sqrt(found["most"]))


def margins_without(
    around: Expansion, curves: np.ndarray, inverse: np.ndarray, reach: float,
    x: np.ndarray, y: np.ndarray, penalty: np.ndarray, allowed: float,
) -> np.ndarray:
    """The margin of each row by the model fitted without it, or NaN where the bound of its error is above `allowed`.

    In the metric A of the whole loss's second derivatives (`curves`), the weights of a fold are `change` away from
    those of all rows, so no row's margin moves by more than r = reach |change|. The derivatives of the logistic
    function are at most its first one, which moves by a factor of at most e^r; what the expansion leaves out of the
    slope is thus at most e^r r^3 |change| / 24. The second derivatives of the fold's own loss are at least 0.68 A
    while the row's pull and r are under their limits, which makes a margin's error at most pull^(1/2) r^3 |change| / 10.
    """
    with np.errstate(all="ignore"):
        pull = ((x @ inverse) * x).sum(axis=1)
        change, last = np.zeros_like(x), np.full(len(x), np.inf)
        moving = np.flatnonzero(pull <= MOST_PULL)
        for _ in range(ROUNDS):
            if not len(moving):
                break
            own, weights = x[moving], around.weights + change[moving]
            p = 0.5 * (1 + np.tanh(0.5 * (own * weights).sum(axis=1)))
            slope = around.slopes_at(change[moving]) - (p - y[moving])[:, None] * own + penalty[moving] * weights
            step = slope @ inverse
            change[moving] -= step
            last[moving] = np.sqrt(pull[moving] * np.maximum((slope * step).sum(axis=1), 0))
            moving = moving[last[moving] > LAST_STEP]
        length = np.sqrt(np.maximum(((change @ curves) * change).sum(axis=1), 0))
        r = reach * length
        sure = (last <= LAST_STEP) & (r <= MOST_CHANGE) & (np.sqrt(pull) * length * r**3 / 10 <= allowed)
        return np.where(sure, (x * (around.weights + change)).sum(axis=1), np.nan)


def without_each(folded: DataFrame, features: Sequence[str]) -> DataFrame:
    """`folded`, where every row is a fold, with `held_out_prob`."""
    whole = np.array(folded.agg(figures(features).alias("s")).first()["s"])
    if whole[1] in (0, whole[0]):
        return folded.withColumn("held_out_prob", F.lit(float(whole[1] > 0)))
    start = fit_whole(folded, features)
    around = expand(folded, start[0], features)
    d = len(features) + 1
    curves = symmetric(around.second, d) + np.diag([1 / INVERSE_PENALTY] * (d - 1) + [0.0])
    inverse = np.linalg.inv(curves)
    reach, allowed = largest_reach(folded, inverse, features), MARGIN_ERROR

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS_AT_ONCE):
            x, y = matrix(batch, features), np.asarray(batch.column(TARGET))
            sums = sums_without(whole, x[:, :-1], y)
            margin = margins_without(around, curves, inverse, reach, x, y, penalties(sums), allowed)
            certain = certain_outcomes(sums)
            probability = np.where(np.isnan(certain), 0.5 * (1 + np.tanh(0.5 * margin)), certain)
            yield batch.append_column("held_out_prob", pa.array(probability, mask=np.isnan(probability)))

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in folded.schema)
    rated = settle(folded.mapInArrow(run, f"{kept}, held_out_prob double"))
    unsure = rated.filter(F.col("held_out_prob").isNull()).select("fold", TARGET, *features)
    if unsure.isEmpty():
        return rated
    path, found = scratch_path(folded.sparkSession, "fits"), unsure.toLocalIterator()
    while rows := sorted(tuple(r) for r in islice(found, max(1, DIRECT_FITS))):
        values = np.array(rows, float)
        sums = sums_without(whole, values[:, 2:], values[:, 1])
        left, moving = values[:, 0].astype(int), np.ones(len(rows), bool)
        weights = newton(folded, np.repeat(start, len(rows), axis=0), penalties(sums), moving, features, left)
        table = [(int(i), w.tolist()) for i, w in zip(left, weights, strict=True)]
        folded.sparkSession.createDataFrame(table, FITS).write.mode("append").parquet(path)
    fits = folded.sparkSession.read.schema(FITS).parquet(path)
    exact = 1 / (1 + F.exp(-margin_of(features)))
    return rated.join(fits, "fold", "left").withColumn("held_out_prob", F.coalesce("held_out_prob", exact)).drop("weights")


FITS = "fold int, weights array<double>"


def margin_of(features: Sequence[str]) -> Column:
    """The margin of a row by its fold's weights."""
    return sum((F.col(f) * F.col("weights")[i] for i, f in enumerate(features)), F.col("weights")[len(features)])


def held_out(
    train: DataFrame, folds: int | None = None, features: Sequence[str] = MATCHUP_FEATURES,
    key: str = "game_id", most_fits: int | None = None,
) -> DataFrame:
    """Every training row with its fold and the home probability by the model that never saw the fold: columns
    game_id, home_win, fold, held_out_prob, correct. NULL folds leave out one row at a time.

    A number of folds above `most_fits` is refused, MOST_FITS if it is NULL; leave-one-out is bounded only by a
    given one. Where the other rows all have one outcome, no fit exists and that outcome is certain. An empty table gives no rows.
    """
    spark = train.sparkSession
    count = train.count()
    single = folds is None
    folds = count if single else folds
    if most_fits is None:
        most_fits = max(folds, MOST_FITS) if single else MOST_FITS
    if folds > most_fits:
        raise ValueError(f"{folds} folds are more than most_fits={most_fits}")
    if not count:
        return train.select(
            key, TARGET, F.lit(0).alias("fold"), F.lit(0.0).alias("held_out_prob"), F.lit(True).alias("correct")
        )
    numbered = with_folds(train.select(key, TARGET, *features), folds, key, most_fits=folds)
    tasks = -(-count // TASK_ROWS)
    few = max(1, min(tasks if folds <= FOLDS_AT_ONCE else max(8, tasks), count))
    folded = settle(scaled(numbered, fit_scales(train, features)).repartition(few))
    if single and folds > DIRECT_FITS:
        rated = without_each(folded, features)
    else:
        fits = fit_folds(folded, folds, features)
        table = [(i, w.tolist(), None if np.isnan(c) else float(c)) for i, (w, c) in enumerate(zip(*fits, strict=True))]
        # A row per fold, at most `most_fits` of them.
        models = F.broadcast(spark.createDataFrame(table, f"{FITS}, certain double"))
        probability = F.coalesce("certain", 1 / (1 + F.exp(-margin_of(features))))
        rated = folded.join(models, "fold").withColumn("held_out_prob", probability)
    return rated.select(
        key, TARGET, "fold", "held_out_prob", ((F.col("held_out_prob") > 0.5) == (F.col(TARGET) > 0.5)).alias("correct")
    )


def held_out_summary(rated: DataFrame) -> DataFrame:
    """Games, correct ones, accuracy and mean log loss of held-out predictions."""
    sure = F.when(F.col(TARGET) > 0.5, F.col("held_out_prob")).otherwise(1 - F.col("held_out_prob"))
    return rated.agg(
        F.count(F.lit(1)).alias("games"),
        F.count_if("correct").alias("correct_games"),
        F.avg(F.col("correct").cast("double")).alias("accuracy"),
        F.avg(-F.log(F.greatest(sure, F.lit(1e-15)))).alias("log_loss"),
    )
