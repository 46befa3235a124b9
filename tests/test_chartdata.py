import random
import statistics

import pytest
from pyspark.sql import functions as F

from playmetrics.operators import chartdata as C


@pytest.fixture(scope="module")
def points(spark):
    rows = [("a", 1, 1.0), ("a", 2, 3.0), ("a", 3, 4.0), ("a", 4, None), ("b", 1, 5.0), ("b", 2, 7.0)]
    rows += [("c", 2, 1.0), ("c", 2, 2.0), ("c", 2, 3.0)]
    return spark.createDataFrame(rows, "g string, x int, y double")


def test_trend(points):
    rows = C.trend(points.filter("g = 'a'"), "x", "y").orderBy("x").collect()
    slope, intercept = statistics.linear_regression([1, 2, 3], [1.0, 3.0, 4.0])
    assert [r["trend"] for r in rows] == pytest.approx([intercept + slope * x for x in (1, 2, 3, 4)])


def test_no_trend_through_two_points_or_a_constant(points):
    got = C.trend_by_group(points, "g", "x", "y").collect()
    assert len(got) == 9
    assert {r["g"] for r in got if r["trend"] is not None} == {"a"}


def test_outliers(spark):
    rows = [(i, float(i), float(i)) for i in range(20)] + [(20, 5.0, 50.0), (21, 6.0, -40.0), (22, None, 1.0), (23, 1.0, None)]
    df = spark.createDataFrame(rows, "id int, x double, y double")
    got = C.outliers(df, "x", "y", ["id"], n=2).collect()
    assert [r["id"] for r in got] == [21, 20] or [r["id"] for r in got] == [20, 21]
    assert C.outliers(df, "x", "y", ["id"], n=100).count() == 22


def test_digit_matrix(spark):
    df = spark.createDataFrame([(0, 7), (0, 7), (3, 7), (9, 9)], "home_digit int, away_digit int")
    got = C.digit_matrix(df).collect()
    cells = {(r["home_digit"], r["away_digit"]): (r["count"], r["percent"]) for r in got}
    assert len(got) == len(cells) == 100
    assert cells[0, 7] == (2, 50.0) and cells[3, 7] == (1, 25.0) and cells[7, 0] == (0, 0.0)
    assert sum(p for _, p in cells.values()) == pytest.approx(100)


def test_histogram(spark):
    df = spark.createDataFrame([(float(i), "a" if i < 5 else "b") for i in range(11)] + [(None, "a")], "v double, g string")
    rows = C.histogram(df, "v", 5).orderBy("bin").collect()
    assert [r["rows"] for r in rows] == [2, 2, 2, 2, 3]
    assert (rows[0]["bin_start"], rows[-1]["bin_end"]) == (0.0, 10.0)
    grouped = C.histogram(df, "v", 5, "g").collect()
    assert sum(r["rows"] for r in grouped) == 11 and {r["g"] for r in grouped} == {"a", "b"}


def test_histogram_of_one_value(spark):
    rows = C.histogram(spark.createDataFrame([(2.0,), (2.0,)], "v double"), "v").collect()
    assert [(r["bin"], r["rows"]) for r in rows] == [(1, 2)]


def test_correlation_matrix(spark):
    rows = [(1.0, 2.0, 5.0, 1.0), (2.0, 4.1, 5.0, None), (3.0, 5.9, 5.0, 3.0), (4.0, None, 5.0, 2.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    got = {(r["x"], r["y"]): r["correlation"] for r in C.correlation_matrix(df, ["a", "b", "c", "d"]).collect()}
    assert len(got) == 16
    assert got["a", "b"] == got["b", "a"] == pytest.approx(statistics.correlation([1, 2, 3], [2.0, 4.1, 5.9]))
    assert got["a", "d"] == pytest.approx(statistics.correlation([1, 3, 4], [1, 3, 2]))
    assert got["a", "a"] == 1.0 and got["c", "c"] is None and got["a", "c"] is None


def test_box_stats_of_winners_and_losers(spark):
    games = spark.createDataFrame([(1, 30, 20), (2, 10, 24), (3, 7, 7)], "game_id int, home_score int, away_score int")
    sides = C.winner_loser_rows(games, "home_score", "away_score", "points")
    got = {r["result"]: (r["low"], r["median"], r["high"]) for r in C.box_stats(sides, "points", "result").collect()}
    assert got == {"Winner": (7, 24, 30), "Loser": (7, 10, 20)}


def test_series_is_ordered(points):
    rows = C.series(points, "x", "y", "g").collect()
    assert [(r["g"], r["x"]) for r in rows] == sorted((r["g"], r["x"]) for r in rows)
    assert C.series(points.select(F.col("x"), F.col("y")), "x", "y").columns == ["x", "y"]


def test_correlations_over_many_sets_of_known_columns(spark, monkeypatch):
    """Far from zero, with holes everywhere, and with more columns than one word of flags."""
    monkeypatch.setattr(C, "FLAGS", 3)
    rng = random.Random(4)
    columns = [f"c{i}" for i in range(9)]
    rows = []
    for _ in range(40):
        base = 1e9 + rng.gauss(0, 1)
        values = [base + rng.gauss(0, 1) for _ in columns]
        values = [None if i < 5 and rng.random() < 0.3 else v for i, v in enumerate(values)]
        values[5], values[6] = 3.0, None
        rows.append(tuple(values))
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns)).repartition(3)
    got = {(r["x"], r["y"]): r["correlation"] for r in C.correlation_matrix(df, columns).collect()}
    assert len(got) == 81
    for i in range(9):
        for j in set(range(9)) - {i}:
            pairs = [(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None]
            if 5 in (i, j) or 6 in (i, j):
                assert got[f"c{i}", f"c{j}"] is None
            else:
                assert got[f"c{i}", f"c{j}"] == pytest.approx(statistics.correlation(*zip(*pairs)), abs=1e-5)


def test_correlations_of_nothing(spark):
    df = spark.createDataFrame([], "a double, b int")
    assert {r["correlation"] for r in C.correlation_matrix(df, ["a", "b"]).collect()} == {None}


def test_histogram_reads_its_input_once(spark):
    df = spark.range(50).selectExpr("double(id) AS v")
    seen = spark.sparkContext.accumulator(0)
    counted = df.mapInPandas(lambda batches: (seen.add(len(b)) or b for b in batches), "v double")
    assert C.histogram(counted, "v", 5).agg(F.sum("rows")).first()[0] == 50
    assert seen.value == 50
