import random
import statistics

import pytest

from playmetrics.operators import grouped as G
from playmetrics.operators.sizing import attach

COLUMNS = "season int, nth long, epa double"
OPTIONS = [pytest.param({}, id="broadcast"), pytest.param({"broadcast_bytes": 0}, id="shuffled")]


def make_rows():
    rng = random.Random(3)
    return [
        (rng.choice([2000, 2000, 2001, None]), i, None if rng.random() < 0.1 else rng.randint(-40, 40) / 10)
        for i in range(400)
    ]


DATA = make_rows()


@pytest.fixture(scope="module")
def plays(spark):
    return spark.createDataFrame(DATA, COLUMNS)


def values():
    found = {}
    for season, _, epa in DATA:
        if epa is not None:
            found.setdefault(season, []).append(epa)
    return {k: sorted(v) for k, v in found.items()}


@pytest.mark.parametrize("options", OPTIONS)
def test_deviation_from_mean(plays, options):
    rows = G.above_group_mean(plays, **options).collect()
    assert len(rows) == len(DATA)
    sums = {}
    for r in rows:
        if r["epa"] is None:
            assert r["epa_above_avg"] is None
        else:
            expected = r["epa"] - statistics.fmean(values()[r["season"]])
            assert r["epa_above_avg"] == pytest.approx(expected)
            sums[r["season"]] = sums.get(r["season"], 0) + r["epa_above_avg"]
    assert set(sums) == {2000, 2001, None}
    assert all(abs(s) < 1e-9 for s in sums.values())


@pytest.mark.parametrize("options", OPTIONS)
def test_share_of_total(spark, options):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0), ("b", -2.0), ("c", None)], "g string, v double")
    got = G.pct_of_group_total(df, "v", "g", **options).orderBy("g", "v").collect()
    assert [r["v_pct_of_total"] for r in got] == [25.0, 75.0, None, None, None]


def nearest(xs, q):
    return xs[int(q * (len(xs) - 1) + 0.5)]


@pytest.mark.parametrize("limit", [10**6, 5])
@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.9, 1.0])
def test_nearest_quantile(plays, limit, q):
    got = G.nearest_quantile(plays, "epa", "season", q, "t", group_limit=limit).collect()
    assert {r["season"]: r["t"] for r in got} == {s: nearest(xs, q) for s, xs in values().items()}


def test_nearest_quantile_takes_the_upper_of_two_middle_values(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0)], "season int, epa double")
    assert G.nearest_quantile(df, "epa", "season", 0.5, "t").first()["t"] == 2.0


@pytest.mark.parametrize("limit", [10**6, 5])
def test_linear_quantiles(plays, limit):
    wanted = {"q1": 0.25, "median": 0.5, "q3": 0.75, "p10": 0.1}
    got = G.linear_quantiles(plays, "epa", "season", wanted, group_limit=limit).collect()
    for r in got:
        xs = values()[r["season"]]
        for name, q in wanted.items():
            place = q * (len(xs) - 1)
            low = int(place)
            high = min(low + 1, len(xs) - 1)
            assert r[name] == pytest.approx(xs[low] + (xs[high] - xs[low]) * (place - low))


@pytest.mark.parametrize("q", [0.5, 0.29])
def test_above_quantile(plays, q):
    alias = f"epa_above_p{int(q * 100)}"
    rows = G.above_group_quantile(plays, quantile=q).collect()
    assert len(rows) == len(DATA)
    for r in rows:
        expected = None if r["epa"] is None else r["epa"] > nearest(values()[r["season"]], q)
        assert r[alias] == expected
    assert alias in ("epa_above_p50", "epa_above_p28")


def test_group_without_values(spark):
    df = spark.createDataFrame([(1, None), (2, 1.0)], "season int, epa double")
    got = {r["season"]: r["epa_above_p50"] for r in G.above_group_quantile(df).collect()}
    assert got == {1: None, 2: False}


def test_attach_keeps_all_rows_and_null_keys(spark):
    left = spark.createDataFrame([(1, "x"), (None, "y"), (3, "z")], "k int, v string")
    side = spark.createDataFrame([(1, 10), (None, 20)], "k int, w int")
    for size in (0, 10_000):
        got = attach(left, side, ["k"], broadcast_bytes=size)
        assert got.columns == ["k", "v", "w"]
        assert {r["v"]: r["w"] for r in got.collect()} == {"x": 10, "y": 20, "z": None}


def test_small_side_is_broadcast_and_large_side_is_not(plays):
    def plan(**options):
        return G.above_group_mean(plays, **options)._jdf.queryExecution().executedPlan().toString()

    assert "BroadcastHashJoin" in plan()
    shuffled = plan(broadcast_bytes=0)
    assert "CartesianProduct" not in shuffled and "NestedLoop" not in shuffled


def test_size_check_sees_nested_values(spark):
    from playmetrics.operators.sizing import small_enough

    wide = spark.range(4).selectExpr("id", "transform(sequence(1, 100000), x -> double(x)) AS v")
    assert not small_enough(wide, 1_000_000) and small_enough(wide, 10_000_000)
    nested = spark.range(4).selectExpr(
        "id", "named_struct('m', map('k', array(repeat('x', 100000))), 'n', CAST(NULL AS BINARY)) AS s"
    )
    assert not small_enough(nested, 100_000) and small_enough(nested, 1_000_000)
    assert small_enough(spark.range(3).selectExpr("id", "CAST(NULL AS ARRAY<STRING>) AS a"), 1_000)
