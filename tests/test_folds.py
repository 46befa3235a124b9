"""Held-out predictions against refits row by row."""

import random

import numpy as np
import pytest

from playmetrics.plans import folds, models

FEATURES = ["edge", "noise", "flat"]
SCHEMA = "game_id long, home_win double, edge double, noise double, flat double"


def rows(n, seed=3, one_sided=False):
    rng = random.Random(seed)
    made = []
    for i in range(n):
        edge = rng.uniform(-1, 1)
        won = edge + rng.gauss(0, 0.4) > 0
        made.append((i * 10, 1.0 if one_sided and i else float(won and not one_sided), edge, rng.uniform(5, 9), 3.0))
    return made


def refit(train, row):
    """One model at a time by Newton steps, on values scaled without the row."""
    x = np.array([r[2:] for r in train])
    y = np.array([r[1] for r in train])
    if len(set(y)) == 1:
        return y[0]
    mean, spread = x.mean(axis=0), x.std(axis=0)
    spread = np.where(spread > 0, spread, 1)
    z = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    keep = np.array([1.0] * len(mean) + [0.0]) / models.INVERSE_PENALTY

    w = np.zeros(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ w))
        slope = z.T @ (p - y) + keep * w
        w = w - np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(keep), slope)
    assert np.abs(slope).max() < 1e-8
    return 1 / (1 + np.exp(-(np.append((np.array(row[2:]) - mean) / spread, 1) @ w)))


def held_out(spark, made, k):
    found = folds.held_out(spark.createDataFrame(made, SCHEMA), k, FEATURES).collect()
    return {r["game_id"]: r for r in found}


@pytest.mark.parametrize("k", [None, 3, 7])
def test_same_as_refits(spark, monkeypatch, k):
    monkeypatch.setattr(folds, "FOLDS_AT_ONCE", 16)
    monkeypatch.setattr(folds, "ROWS_AT_ONCE", 9)
    made = rows(40)
    found = held_out(spark, made, k)
    assert len(found) == 40
    for i, row in enumerate(made):
        fold = i % (k or 40)
        assert found[row[0]]["fold"] == fold
        train = [r for j, r in enumerate(made) if j % (k or 40) != fold]
        p = refit(train, row)
        assert found[row[0]]["held_out_prob"] == pytest.approx(p, abs=1e-6)
        assert found[row[0]]["correct"] == ((p > 0.5) == (row[1] > 0.5))


@pytest.mark.parametrize("allowed", [1e-6, -1.0])
def test_expansions_same_as_refits(spark, monkeypatch, allowed):
    """Rows by the expansion, by sums over all rows, and both, the last 80 at a time."""
    monkeypatch.setattr(folds, "DIRECT_FITS", 80)
    monkeypatch.setattr(folds, "MARGIN_ERROR", allowed)
    direct = []
    newton = folds.newton

    def counted(rows, weights, penalty, moving, features, left):
        direct.append(0 if left is None else len(left))
        return newton(rows, weights, penalty, moving, features, left)

    monkeypatch.setattr(folds, "newton", counted)
    made = rows(150)
    made[7] = (*made[7][:3], 20.0, 3.0)  # a row with a large pull
    found = held_out(spark, made, None)
    assert len(found) == 150 and max(direct) <= 80
    assert sum(direct) == 150 if allowed < 0 else 0 < sum(direct) < 150, direct
    for i, row in enumerate(made):
        assert found[row[0]]["fold"] == i
        p = refit(made[:i] + made[i + 1 :], row)
        assert found[row[0]]["held_out_prob"] == pytest.approx(p, abs=1e-6)
        assert found[row[0]]["correct"] == ((p > 0.5) == (row[1] > 0.5))


def test_expansions_of_one_outcome(spark, monkeypatch):
    monkeypatch.setattr(folds, "DIRECT_FITS", 2)
    found = held_out(spark, rows(40, one_sided=True), None)
    assert found[0]["held_out_prob"] == 1.0 and not found[0]["correct"]
    assert all(0 < found[k]["held_out_prob"] < 1 for k in found if k)
    same = held_out(spark, [(*r[:1], 1.0, *r[2:]) for r in rows(40)], None)
    assert len(same) == 40 and all(r["held_out_prob"] == 1.0 and r["correct"] for r in same.values())


def test_more_rows_than_fits_at_once(spark):
    made = rows(folds.MOST_FITS + 1)
    found = held_out(spark, made, None)
    assert len(found) == len(made)
    for i in (0, 1, 9_999, len(made) - 1):
        assert found[made[i][0]]["held_out_prob"] == pytest.approx(refit(made[:i] + made[i + 1 :], made[i]), abs=1e-9)


def test_one_outcome_left(spark):
    made = rows(6, one_sided=True)  # the only loss is left out in one fold
    found = held_out(spark, made, None)
    assert found[0]["held_out_prob"] == 1.0 and not found[0]["correct"]
    assert all(0 < found[r[0]]["held_out_prob"] < 1 for r in made[1:])


def test_empty_and_single(spark):
    assert held_out(spark, [], None) == {}
    assert len(held_out(spark, rows(1), None)) == 1


def test_too_many_folds(spark):
    with pytest.raises(ValueError):
        folds.held_out(spark.createDataFrame(rows(5), SCHEMA), None, FEATURES, most_fits=4)


def test_summary(spark):
    table = spark.createDataFrame([(1, 1.0, 0, 0.8, True), (2, 0.0, 1, 0.6, False)], "game_id long, home_win double, fold int, held_out_prob double, correct boolean")
    got = folds.held_out_summary(table).first()
    assert got[:3] == (2, 1, 0.5) and got["log_loss"] == pytest.approx(-(np.log(0.8) + np.log(0.4)) / 2)


def test_one_feature_of_more_rows_than_fits(spark):
    made = [r[:3] for r in rows(folds.MOST_FITS + 50, seed=4)]
    table = spark.createDataFrame(made, "game_id long, home_win double, edge double")
    found = {r["game_id"]: r for r in folds.held_out(table, None, ["edge"]).collect()}
    assert len(found) == len(made)
    for i in (0, 77, len(made) - 1):
        p = refit(made[:i] + made[i + 1 :], made[i])
        assert found[made[i][0]]["held_out_prob"] == pytest.approx(p, abs=1e-9)


def test_summary_of_more_rows_than_fits(spark):
    made = rows(folds.MOST_FITS + 9, seed=5)
    rated = folds.held_out(spark.createDataFrame(made, SCHEMA), None, FEATURES)
    got, each = folds.held_out_summary(rated).first(), rated.collect()
    assert got["games"] == len(each) == len(made)
    assert got["correct_games"] == sum(r["correct"] for r in each) > 0.7 * len(made)
    losses = [-np.log(r["held_out_prob"] if r["home_win"] else 1 - r["held_out_prob"]) for r in each]
    assert got["log_loss"] == pytest.approx(np.mean(losses))
