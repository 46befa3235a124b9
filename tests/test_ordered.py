"""The ordered operators against brute force, with and without splitting of large groups."""

import math
import random

import pytest
from pyspark.sql import functions as F

from playmetrics.operators import ordered as O

ROWS = 600
COLUMNS = "team string, nth long, epa double, play_type string, yards_gained double, wp double"

# Group "hot" holds a third of the rows and NULL is a group like any other.
LIMITS = [pytest.param(10**6, id="plain"), pytest.param(40, id="split")]


def make_rows():
    rng = random.Random(7)
    rows = []
    for i in range(ROWS):
        team = "hot" if i % 3 == 0 else rng.choice(["a", "b", "c", "d", "e", "f", "g", None])
        epa = None if rng.random() < 0.1 else rng.randint(-50, 50) / 10
        kind = None if rng.random() < 0.05 else rng.choice(["pass", "run"])
        wp = None if rng.random() < 0.05 else rng.randint(0, 100) / 100
        rows.append((team, i, epa, kind, float(rng.randint(0, 20)), wp))
    rng.shuffle(rows)
    return rows


DATA = make_rows()


@pytest.fixture(scope="module")
def plays(spark):
    return spark.createDataFrame(DATA, COLUMNS).repartition(5)


def groups(keyed=True):
    found = {}
    for row in sorted(DATA, key=lambda r: r[1]):
        found.setdefault(row[0] if keyed else None, []).append(row)
    return found


def by_nth(df, column):
    rows = df.select("nth", F.col(f"`{column}`").alias("y")).collect()
    assert len(rows) == ROWS
    return {r["nth"]: r["y"] for r in rows}


def assert_same(got, expected):
    assert got.keys() == expected.keys()
    for nth, value in expected.items():
        if value is None:
            assert got[nth] is None, nth
        else:
            assert got[nth] == pytest.approx(value, abs=1e-9), nth


def mean_of_last(values, n, least):
    known = [v for v in values[-n:] if v is not None]
    return sum(known) / len(known) if len(known) >= least else None


@pytest.mark.parametrize("limit", LIMITS)
@pytest.mark.parametrize("keyed", [True, False])
def test_running_total(plays, limit, keyed):
    expected = {}
    for rows in groups(keyed).values():
        total = 0.0
        for r in rows:
            total += r[2] or 0.0
            expected[r[1]] = None if r[2] is None else total
    got = O.cumulative_epa(plays, ["nth"], "team" if keyed else None, group_limit=limit)
    assert got.columns == [*plays.columns, "cumulative_epa"]
    assert_same(by_nth(got, "cumulative_epa"), expected)


@pytest.mark.parametrize("limit", LIMITS)
@pytest.mark.parametrize(
    ("operator", "column", "value"),
    [
        (O.rolling_epa, "rolling_epa_25", lambda r: r[2]),
        (O.rolling_success_rate, "rolling_success_rate_25", lambda r: None if r[2] is None else float(r[2] > 0)),
        (O.rolling_pass_rate, "rolling_pass_rate_25", lambda r: None if r[3] is None else float(r[3] == "pass")),
        (O.rolling_yards_per_play, "rolling_ypp_25", lambda r: r[4]),
    ],
)
def test_rolling(plays, limit, operator, column, value):
    expected = {}
    for rows in groups().values():
        values = [value(r) for r in rows]
        for i, r in enumerate(rows):
            expected[r[1]] = mean_of_last(values[: i + 1], 25, 10)
    got = operator(plays, "team", ["nth"], window_size=25, group_limit=limit)
    assert_same(by_nth(got, column), expected)


def test_window_larger_than_the_group_limit(plays):
    expected = {}
    for rows in groups().values():
        values = [r[2] for r in rows]
        for i, r in enumerate(rows):
            expected[r[1]] = mean_of_last(values[: i + 1], 90, 10)
    got = O.rolling_epa(plays, "team", ["nth"], window_size=90, group_limit=7)
    assert_same(by_nth(got, "rolling_epa_90"), expected)


@pytest.mark.parametrize("limit", LIMITS)
@pytest.mark.parametrize("window", [1, 4, 10])
def test_rolling_beside_infinite_values(spark, limit, window):
    """A value that is no finite number counts in the windows that hold it and in no other."""
    odd = {3: float("inf"), 9: float("nan"), 17: float("-inf"), 18: float("inf"), 25: None, 30: 1e300, 31: -1e300}
    values = [odd.get(i, i / 7) for i in range(60)]
    df = spark.createDataFrame(list(enumerate(values)), "nth int, v double").withColumn("team", O.F.lit("a"))
    got = O.rolling(df, O.F.col("v"), "mean", window, "team", ["nth"], min_values=1, group_limit=limit)
    assert got.columns == [*df.columns, "mean"]
    for r in got.collect():
        known = [v for v in values[max(0, r["nth"] - window + 1) : r["nth"] + 1] if v is not None]
        want = sum(known) / len(known) if known else None
        assert (r["mean"] is None) == (want is None)
        if want is not None and not (abs(want) < 1e3 and any(abs(v) == 1e300 for v in values[max(0, r["nth"] - 2 * window) : r["nth"] + 1] if v)):
            assert r["mean"] == pytest.approx(want, nan_ok=True)


def test_rolling_takes_one_step_per_row(spark):
    """No frame of the plan has the window's length."""
    df = spark.range(10).withColumn("v", O.F.col("id").cast("double"))
    plan = O.rolling(df, O.F.col("v"), "m", 5000, "id", ["v"])._jdf.queryExecution().executedPlan().toString()
    assert "-4999" not in plan.replace("lag(__rest", "") and plan.count("Exchange hashpartitioning") <= 1


def pearson(pairs):
    pairs = [(x, y) for x, y in pairs if x is not None and y is not None]
    if len(pairs) < 20:
        return None
    mx, my = (sum(c) / len(pairs) for c in zip(*pairs))
    sxx, syy = sum((x - mx) ** 2 for x, _ in pairs), sum((y - my) ** 2 for _, y in pairs)
    if len({x for x, _ in pairs}) == 1 or len({y for _, y in pairs}) == 1:
        return None
    return sum((x - mx) * (y - my) for x, y in pairs) / math.sqrt(sxx * syy)


@pytest.mark.parametrize("limit", LIMITS)
def test_rolling_correlation(plays, limit):
    expected = {}
    for rows in groups().values():
        pairs = [(None if r[3] is None else float(r[3] == "pass"), r[5]) for r in rows]
        for i, r in enumerate(rows):
            expected[r[1]] = pearson(pairs[max(0, i - 29) : i + 1])
    got = O.pass_rate_wp_correlation(plays, "team", ["nth"], window_size=30, group_limit=limit)
    assert any(v is not None for v in expected.values())
    assert_same(by_nth(got, "pass_wp_correlation"), expected)


def test_rolling_correlation_of_a_constant_is_null(spark):
    df = spark.range(40).select(
        F.lit("a").alias("team"), F.col("id").alias("nth"), F.lit("pass").alias("play_type"),
        (F.col("id") / 40).alias("wp"),
    )
    got = O.pass_rate_wp_correlation(df, "team", ["nth"])
    assert got.filter(F.col("pass_wp_correlation").isNotNull()).count() == 0


@pytest.mark.parametrize("limit", LIMITS)
@pytest.mark.parametrize("keyed", [True, False])
@pytest.mark.parametrize("periods", [1, 3, -2, 45])
def test_lag(plays, limit, keyed, periods):
    expected = {}
    for rows in groups(keyed).values():
        for i, r in enumerate(rows):
            j = i - periods
            expected[r[1]] = rows[j][2] if 0 <= j < len(rows) else None
    got = O.lag_value(plays, "epa", ["nth"], periods, "team" if keyed else None, group_limit=limit)
    assert_same(by_nth(got, f"epa_lag{periods}"), expected)


@pytest.mark.parametrize("limit", LIMITS)
def test_delta(plays, limit):
    expected = {}
    for rows in groups().values():
        for i, r in enumerate(rows):
            known = i > 0 and r[2] is not None and rows[i - 1][2] is not None
            expected[r[1]] = r[2] - rows[i - 1][2] if known else None
    got = O.delta_from_previous(plays, ["epa", "wp"], ["nth"], "team", group_limit=limit)
    assert got.columns[-2:] == ["epa_delta", "wp_delta"]
    assert_same(by_nth(got, "epa_delta"), expected)


@pytest.mark.parametrize("limit", LIMITS)
@pytest.mark.parametrize("descending", [True, False])
def test_ranks(plays, limit, descending):
    got = O.rank_within_group(plays, ["epa", "wp"], "team", ["nth"], descending, group_limit=limit)
    for column, index in (("epa", 2), ("wp", 5)):
        expected = {r[1]: None for r in DATA}
        for rows in groups().values():
            known = [r for r in rows if r[index] is not None]
            known.sort(key=lambda r: (-r[index] if descending else r[index], r[1]))
            expected |= {r[1]: i + 1 for i, r in enumerate(known)}
        assert_same(by_nth(got, f"{column}_rank"), expected)


@pytest.mark.parametrize("limit", LIMITS)
def test_numbers(plays, limit):
    expected = {r[1]: i + 1 for rows in groups().values() for i, r in enumerate(rows)}
    got = O.number_rows(plays, "n", "team", ["nth"], group_limit=limit)
    assert_same(by_nth(got, "n"), expected)


@pytest.mark.parametrize("n", [1, 4, 60])
def test_results_do_not_depend_on_partitions(plays, shuffle_partitions, n):
    shuffle_partitions(n)
    shuffled = plays.repartition(n, F.rand(seed=n))
    wide = O.rolling_epa(shuffled, "team", ["nth"], window_size=25, group_limit=40)
    got = O.cumulative_epa(wide, ["nth"], "team", group_limit=40)
    expected = {}
    for rows in groups().values():
        values = [r[2] for r in rows]
        for i, r in enumerate(rows):
            mean = mean_of_last(values[: i + 1], 25, 10)
            total = None if r[2] is None else sum(v or 0.0 for v in values[: i + 1])
            expected[r[1]] = (mean, total)
    rows = got.collect()
    assert len(rows) == ROWS
    for r in rows:
        mean, total = expected[r["nth"]]
        assert (r["rolling_epa_25"] is None) == (mean is None)
        assert mean is None or r["rolling_epa_25"] == pytest.approx(mean)
        assert (r["cumulative_epa"] is None) == (total is None)
        assert total is None or r["cumulative_epa"] == pytest.approx(total)


def test_no_task_sees_a_large_group(plays):
    """After the split no window partition holds more rows than the limit and its margins."""
    placed = O.with_positions(plays.filter("team = 'hot'"), ["team"], ["nth"], ROWS, 40)
    positions = sorted(r[O.POSITION] for r in placed.collect())
    assert positions == list(range(1, len(positions) + 1))
    blocked = O.blocks(plays, ["team"], ["nth"], ROWS, 40)
    largest = blocked.groupBy("team", O.BLOCK).count().agg(F.max("count")).first()[0]
    assert largest < 200


def test_empty_input(spark):
    empty = spark.createDataFrame([], COLUMNS)
    for limit in (10, 10**6):
        assert O.rolling_epa(empty, "team", ["nth"], group_limit=limit).count() == 0
        assert O.cumulative_epa(empty, ["nth"], group_limit=limit).count() == 0
        assert O.rank_within_group(empty, "epa", "team", ["nth"], group_limit=limit).count() == 0


@pytest.mark.parametrize("window", [20, 100, 1000])
def test_rolling_correlation_far_from_zero(spark, window):
    """Large offsets, a jump and a NaN: only windows that hold the NaN may lose their figure."""
    rng = random.Random(11)
    rows = []
    for i in range(300):
        level = 1e9 if i < 150 else 0.0
        rows.append((i, level + rng.random(), level + rng.random()))
    rows[200] = (200, math.nan, 0.5)
    df = spark.createDataFrame(rows, "nth long, x double, y double")
    got = O.rolling_correlation(
        df.withColumn("g", F.lit(1)), F.col("x"), F.col("y"), "c", window, "g", ["nth"], min_pairs=20
    )
    values = {r["nth"]: r["c"] for r in got.collect()}
    for i in range(300):
        held = rows[max(0, i - window + 1) : i + 1]
        if any(math.isnan(x) for _, x, _ in held):
            assert values[i] is None or math.isnan(values[i])
        elif len(held) < 20:
            assert values[i] is None
        else:
            expected = pearson([(x, y) for _, x, y in held])
            assert values[i] == pytest.approx(expected, abs=1e-6)


def test_ranks_compare_whole_values(spark):
    df = spark.createDataFrame([("g", "a", 0.1234561), ("g", "b", 0.1234564)], "g string, id string, v double")
    ranks = lambda **o: {r["id"]: r["v_rank"] for r in O.rank_within_group(df, "v", "g", ["id"], **o).collect()}
    assert ranks() == {"a": 2, "b": 1} and ranks(digits=6) == {"a": 1, "b": 2}
