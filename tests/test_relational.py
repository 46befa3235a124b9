import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from playmetrics.operators import relational as R


def test_drop_missing_keeps_nan(spark):
    df = spark.createDataFrame([(1, math.nan), (2, None), (3, 1.0)], "i int, x double")
    assert [r["i"] for r in R.drop_missing(df, ["x"]).orderBy("i").collect()] == [1, 3]


def test_prefix_spares_keys(spark):
    df = spark.createDataFrame([("A", 1, 2.0)], "posteam string, season int, off_epa double")
    assert R.prefix_columns(df, "home_", ["posteam", "season"]).columns == ["posteam", "season", "home_off_epa"]


def test_union_takes_common_columns_at_the_wider_type(spark):
    left = spark.createDataFrame([(1, 2, True, "x", 1.5)], "b int, a int, flag boolean, only string, d double")
    right = spark.createDataFrame([("n/a", 3.5, 7, 2)], "b string, a double, flag int, d int")
    got = R.union_on_common(left, right)
    assert got.columns == ["a", "b", "d", "flag"]
    assert dict(got.dtypes) == {"a": "double", "b": "string", "d": "double", "flag": "int"}
    assert sorted(tuple(r) for r in got.collect()) == [(2.0, "1", 1.5, 1), (3.5, "n/a", 2.0, 7)]
    assert dict(R.union_on_common(right, left).dtypes) == dict(got.dtypes)


def test_shared_type():
    assert R.shared_type(T.IntegerType(), T.IntegerType()) is None
    assert R.shared_type(T.IntegerType(), T.StringType()) == T.StringType()
    assert R.shared_type(T.BooleanType(), T.LongType()) == T.LongType()
    assert R.shared_type(T.IntegerType(), T.DoubleType()) is None


def test_replace_seasons_twice_is_once(spark):
    stored = spark.createDataFrame([(2000, 1.0), (2001, 2.0), (2001, 3.0)], "season int, epa double")
    new = spark.createDataFrame([(2001, 9.0), (2002, 4.0)], "season int, epa double")
    once = R.replace_seasons(stored, new)
    twice = R.replace_seasons(once, new)
    expected = [(2000, 1.0), (2001, 9.0), (2002, 4.0)]
    for got in (once, twice):
        assert sorted((r["season"], r["epa"]) for r in got.collect()) == expected


def test_season_pairs_skip_gaps(spark):
    df = spark.createDataFrame([("a", 2000, 1.0), ("a", 2001, 5.0), ("a", 2003, 9.0)], "who string, season int, v double")
    got = R.season_pairs(df, "who", {"v": ("now", "later")}).collect()
    assert [tuple(r) for r in got] == [("a", 2000, 1.0, 5.0)]


def test_head_and_tail(spark):
    df = spark.createDataFrame([(i,) for i in (5, 3, 9, 1, 7)], "i int")
    assert [r["i"] for r in R.head(df, ["i"], 2).collect()] == [1, 3]
    assert [r["i"] for r in R.tail(df, ["i"], 2).collect()] == [7, 9]


def test_best_per_group(spark):
    rows = [("A", "y", 90, 1), ("A", "x", 90, 2), ("A", "z", 80, 3), ("B", "q", None, 4), ("B", "r", 10, 5), ("C", "n", None, 6)]
    df = spark.createDataFrame(rows, "team string, player string, ovr int, other int")
    got = {r["team"]: (r["player"], r["ovr"], r["other"]) for r in R.best_per_group(df, "team", "ovr", ["player"]).collect()}
    assert got == {"A": ("x", 90, 2), "B": ("r", 10, 5), "C": ("n", None, 6)}


def test_rows_without(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "game_id int")
    excluded = spark.createDataFrame([(2,), (2,)], "game_id int")
    assert R.rows_without(df, None, "game_id") is df
    assert R.rows_without(df, excluded, "game_id").count() == 2


def test_common_columns(spark):
    a = spark.createDataFrame([], "z int, x int, y int")
    b = spark.createDataFrame([], "y int, z int")
    assert R.common_columns(a, b) == ["y", "z"]
    with pytest.raises(Exception):
        R.union_on_common(a, b.withColumn("y", F.array(F.lit(1)))).collect()
