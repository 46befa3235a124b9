"""Registered leave-one-out queries over more games than models are fitted one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from playmetrics.plans import folds
from playmetrics.queries import QUERIES
from playmetrics.queries.heldout import MARKET
from playmetrics.queries.models import FEATURES, training
from tests.test_folds import refit

GAMES, TEAMS, PASSERS = folds.MOST_FITS + 30, 25, 400


def pick(values, by):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(by) % len(values) + 1).cast("int"))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A season of final games only, with two plays each."""
    folder = str(tmp_path_factory.mktemp("finals"))
    key = F.col("id") * 50
    day = F.make_timestamp(F.lit(1995), F.col("id") % 12 + 1, F.lit(3), F.lit(0), F.lit(0), F.lit(0))
    made = {
        "nation": spark.range(TEAMS).select(
            F.col("id").cast("int").alias("n_nationkey"), F.format_string("TEAM %d", "id").alias("n_name")
        ),
        "customer": spark.range(PASSERS).select(
            F.col("id").alias("c_custkey"), (F.col("id") % TEAMS).cast("int").alias("c_nationkey"),
            (F.col("id") * 13.0).alias("c_acctbal"),
        ),
        "part": spark.range(PASSERS).select(F.col("id").alias("p_partkey"), F.lit("red green").alias("p_name")),
        "supplier": spark.range(TEAMS).select(
            F.col("id").alias("s_suppkey"), F.col("id").cast("int").alias("s_nationkey")
        ),
        "orders": spark.range(GAMES).select(
            key.alias("o_orderkey"), F.pmod(F.hash("id"), F.lit(PASSERS)).cast("long").alias("o_custkey"),
            day.alias("o_orderdate"), pick(["1-URGENT", "2-HIGH", "3-MEDIUM"], "id").alias("o_orderpriority"),
        ),
        "lineitem": spark.range(2 * GAMES).withColumn("h", F.pmod(F.xxhash64("id"), F.lit(1_000_000))).select(
            (F.floor(F.col("id") / 2) * 50).alias("l_orderkey"), (F.col("h") % PASSERS).alias("l_partkey"),
            (F.col("h") % TEAMS).alias("l_suppkey"), (F.col("h") % 7 + 1).cast("int").alias("l_linenumber"),
            (F.col("h") % 50 + 1.0).alias("l_quantity"), (F.col("h") / 100).alias("l_extendedprice"),
            (F.col("h") % 11 / 100).alias("l_discount"), (F.col("h") % 9 / 100).alias("l_tax"),
            pick(["A", "R", "N"], "h").alias("l_returnflag"), pick(["F", "O"], "id").alias("l_linestatus"),
        ),
    }
    for name, rows in made.items():
        rows.write.parquet(f"{folder}/{name}.parquet")
    return folder


def games(spark, folder, features):
    return sorted(tuple(r) for r in training(spark, folder).select("game_id", folds.TARGET, *features).collect())


def test_market_of_more_games_than_fits(spark, tables):
    made = games(spark, tables, [MARKET])
    found = {r["game_id"]: r for r in QUERIES["leave_one_out_market"](spark, tables).collect()}
    assert len(made) == GAMES and found.keys() == {r[0] for r in made}
    assert 0 < sum(r[1] for r in made) < GAMES
    for i in (0, 1, 4_096, GAMES - 1):
        p = refit(made[:i] + made[i + 1 :], made[i])
        assert found[made[i][0]]["held_out_prob"] == pytest.approx(p, abs=1e-6)
        assert found[made[i][0]]["correct"] == ((p > 0.5) == (made[i][1] > 0.5))


def test_summary_of_more_games_than_fits(spark, tables):
    made = games(spark, tables, FEATURES)
    each = {r["game_id"]: r for r in QUERIES["leave_one_out"](spark, tables).collect()}
    for i in (0, 10_000, GAMES - 1):
        p = refit(made[:i] + made[i + 1 :], made[i])
        assert each[made[i][0]]["held_out_prob"] == pytest.approx(p, abs=1e-6)
    (got,) = QUERIES["leave_one_out_summary"](spark, tables).collect()
    losses = [-np.log(r["held_out_prob"] if r["home_win"] else 1 - r["held_out_prob"]) for r in each.values()]
    assert len(made) == GAMES and got["games"] == len(each) == GAMES
    assert got["correct_games"] == sum(r["correct"] for r in each.values())
    assert got["accuracy"] == pytest.approx(got["correct_games"] / GAMES)
    assert got["log_loss"] == pytest.approx(np.mean(losses), abs=1e-9)
