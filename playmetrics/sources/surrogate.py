"""Plays, games and ratings views over the star-schema test tables.

The same texts make the Spark views and, with plain table names, the oracle queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# A total order of the plays: (game_id, play_id) alone repeats.
PLAY_ORDER = ["game_id", "play_id", "tie1", "tie2", "tie3"]

# The dimensions are joined among themselves first: the plays then move once for the defense
# and once for the game, and the orders once for the passer.
PLAYS_SQL = """
SELECT l.l_orderkey AS game_id, l.l_linenumber AS play_id, l.l_partkey AS tie1, l.l_suppkey AS tie2,
       CAST(round(l.l_extendedprice * 100) AS BIGINT) AS tie3,
       CAST(year(o.o_orderdate) AS INT) AS season,
       CASE WHEN month(o.o_orderdate) = 12 THEN 'POST' ELSE 'REG' END AS season_type,
       nc.n_name AS posteam, ns.n_name AS defteam,
       o.o_custkey AS passer_id,
       concat(substr(p.p_name, 1, 1), '.', split_part(p.p_name, ' ', 2), CAST(c.c_custkey AS STRING)) AS name,
       CASE l.l_returnflag WHEN 'A' THEN 'pass' WHEN 'R' THEN 'run' ELSE 'punt' END AS play_type,
       CASE WHEN l.l_linestatus = 'F' AND l.l_linenumber = 7 THEN NULL
            ELSE round(l.l_discount * 100 - 5 + (l.l_quantity - 25) / 10, 1) + CAST(0 AS DOUBLE) END AS epa,
       CAST(l.l_partkey % 100 AS INT) AS yardline_100,
       CAST(l.l_linenumber % 4 + 1 AS INT) AS down,
       CASE WHEN l.l_linenumber = 6 THEN NULL ELSE round(l.l_tax * 100, 0) + CAST(0 AS DOUBLE) END AS cpoe,
       round(l.l_quantity, 0) AS yards_gained,
       CASE WHEN l.l_linenumber = 5 THEN NULL ELSE CAST(l.l_partkey % 30 AS DOUBLE) END AS air_yards,
       CASE WHEN l.l_linenumber = 5 THEN NULL ELSE CAST(l.l_partkey % 13 AS DOUBLE) END AS yards_after_catch,
       CASE WHEN l.l_returnflag = 'A' THEN CAST(l.l_partkey % 35 AS DOUBLE) END AS passing_yards,
       CASE WHEN l.l_returnflag = 'R' THEN CAST(l.l_partkey % 12 AS DOUBLE) END AS rushing_yards,
       CASE WHEN l.l_returnflag = 'A' THEN 1 ELSE 0 END AS pass_attempt,
       CASE WHEN l.l_returnflag = 'A' AND l.l_partkey % 3 > 0 THEN 1 ELSE 0 END AS complete_pass,
       CASE WHEN l.l_returnflag = 'A' AND l.l_partkey % 20 = 0 THEN 1 ELSE 0 END AS pass_touchdown,
       CASE WHEN l.l_returnflag = 'R' AND l.l_partkey % 25 = 0 THEN 1 ELSE 0 END AS rush_touchdown,
       CASE WHEN l.l_partkey % 40 = 0 THEN 1 ELSE 0 END AS interception,
       CASE WHEN l.l_partkey % 55 = 0 THEN 1 ELSE 0 END AS fumble_lost,
       CASE WHEN l.l_partkey % 50 = 0 THEN 1 ELSE 0 END AS fumble_forced,
       CASE WHEN l.l_partkey % 15 = 0 THEN 1 ELSE 0 END AS sack,
       CASE WHEN l.l_partkey % 9 = 0 THEN 1 ELSE 0 END AS qb_hit,
       CASE WHEN l.l_linenumber % 4 = 2 AND l.l_partkey % 2 = 0 THEN 1 ELSE 0 END AS third_down_converted,
       CASE WHEN l.l_linenumber % 4 = 2 AND l.l_partkey % 2 = 1 THEN 1 ELSE 0 END AS third_down_failed,
       (l.l_partkey % 101) / CAST(100 AS DOUBLE) AS wp
FROM {lineitem} l
JOIN ({supplier} s JOIN {nation} ns ON s.s_nationkey = ns.n_nationkey) ON l.l_suppkey = s.s_suppkey
JOIN ({orders} o
      JOIN ({customer} c
            JOIN {part} p ON p.p_partkey = c.c_custkey
            JOIN {nation} nc ON c.c_nationkey = nc.n_nationkey)
        ON o.o_custkey = c.c_custkey)
  ON l.l_orderkey = o.o_orderkey
"""

GAMES_SQL = """
SELECT o.o_orderkey AS game_id, CAST(year(o.o_orderdate) AS INT) AS season,
       CASE WHEN o.o_orderkey % 50 = 0 THEN 'SB' ELSE 'REG' END AS game_type,
       nh.n_name AS home_team, na.n_name AS away_team,
       CAST((o.o_orderkey * 7 + o.o_custkey) % 45 AS INT) AS home_score,
       CAST((o.o_orderkey * 11 + o.o_custkey * 3) % 45 AS INT) AS away_score,
       CASE WHEN o.o_custkey % 17 = 0 THEN NULL ELSE (o.o_custkey % 29 - 14) / CAST(2 AS DOUBLE) END AS spread_line,
       CASE WHEN o.o_custkey % 19 = 0 THEN NULL ELSE 40 + (o.o_orderkey % 20) / CAST(2 AS DOUBLE) END AS total_line,
       CASE o.o_orderpriority WHEN '1-URGENT' THEN 'dome' WHEN '2-HIGH' THEN 'Closed'
            WHEN '3-MEDIUM' THEN 'outdoors' WHEN '5-LOW' THEN 'Dome' END AS roof,
       CASE WHEN o.o_custkey % 10 = 0 THEN NULL ELSE CAST(o.o_custkey % 100 AS DOUBLE) END AS temp,
       CASE WHEN o.o_custkey % 11 = 0 THEN NULL ELSE CAST(o.o_orderkey % 30 AS DOUBLE) END AS wind
FROM {orders} o
JOIN {customer} c ON o.o_custkey = c.c_custkey
JOIN {nation} nh ON c.c_nationkey = nh.n_nationkey
JOIN {nation} na ON (c.c_nationkey + 7) % 25 = na.n_nationkey
"""

RATINGS_SQL = """
SELECT CAST(1995 + c.c_custkey % 7 AS INT) AS season, n.n_name AS team,
       CASE c.c_custkey % 5 WHEN 0 THEN 'QB' WHEN 1 THEN 'HB' WHEN 2 THEN 'Free Safety' WHEN 3 THEN 'wr' ELSE 'DT' END AS position,
       concat(p.p_name, CAST(c.c_custkey AS STRING),
              CASE c.c_custkey % 6 WHEN 0 THEN ' Jr.' WHEN 1 THEN ' III' WHEN 2 THEN ' II ' WHEN 3 THEN '-Smith' ELSE '' END) AS player_name,
       CAST(60 + abs(CAST(floor(c.c_acctbal) AS BIGINT)) % 40 AS INT) AS overall
FROM {customer} c
JOIN {nation} n ON c.c_nationkey = n.n_nationkey
JOIN {part} p ON p.p_partkey = c.c_custkey
"""


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """The view over the Parquet files of a folder, without touching the session's views."""
    paths = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}
    return spark.sql(text.format(**paths))


def oracle_view(text: str) -> str:
    """The same text over tables of these names."""
    return text.format(**{t: t for t in TABLES}).strip()


def plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, PLAYS_SQL)


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, GAMES_SQL)


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, RATINGS_SQL)
