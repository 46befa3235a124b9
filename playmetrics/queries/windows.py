"""Window queries on plays, events and season rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from playmetrics.functions.scalars import next_season_changes
from playmetrics.operators import grouped, ordered
from playmetrics.operators.relational import season_pairs
from playmetrics.operators.sizing import settle, settle_table
from playmetrics.plans import players
from playmetrics.queries.base import query
from playmetrics.queries.people import STATS
from playmetrics.sources import surrogate
from playmetrics.sources.surrogate import PLAY_ORDER

ORDER = ", ".join(PLAY_ORDER)
TEAM = ["posteam", "season"]
EVENT_ORDER = ["ts", "event_id"]


def play_rows(spark, sf_dir, *columns):
    return surrogate.plays(spark, sf_dir).select(*PLAY_ORDER, *columns)


def settled_plays(spark, sf_dir, *columns):
    """The same written once: ordered operators count groups before they read the rows, and need
    not repeat the joins behind the view."""
    return settle_table(play_rows(spark, sf_dir, *columns), "plays")


# --- rows against their group ------------------------------------------------------


@query(
    "above_avg",
    f"""SELECT {ORDER}, season, epa, epa - avg(epa) OVER (PARTITION BY season) AS epa_above_avg FROM plays""",
    ["plays"],
    ["epa_above_avg"],
)
def above_avg(spark, sf_dir):
    return grouped.above_group_mean(play_rows(spark, sf_dir, "season", "epa"))


# The value at position floor(q * (n - 1) + 0.5) + 1 among the group's known values.
NEAREST = """
SELECT season, min(epa) FILTER (WHERE nth = CAST(floor({q} * (n - 1) + 0.5) AS BIGINT) + 1) AS threshold
FROM (SELECT season, epa, row_number() OVER (PARTITION BY season ORDER BY epa) AS nth,
             count(*) OVER (PARTITION BY season) AS n FROM plays WHERE epa IS NOT NULL) AS v
GROUP BY season
"""

ABOVE = f"""
SELECT {ORDER}, p.season, epa, epa > threshold AS {{alias}}
FROM plays p LEFT JOIN thresholds t ON p.season IS NOT DISTINCT FROM t.season
"""


@query(
    "above_median",
    ABOVE.format(alias="epa_above_p50"),
    ["plays"],
    ctes={"thresholds": NEAREST.format(q="CAST(0.5 AS DOUBLE)")},
)
def above_median(spark, sf_dir):
    return grouped.above_group_quantile(play_rows(spark, sf_dir, "season", "epa"))


@query(
    "above_p90",
    ABOVE.format(alias="epa_above_p90"),
    ["plays"],
    ctes={"thresholds": NEAREST.format(q="CAST(0.9 AS DOUBLE)")},
)
def above_p90(spark, sf_dir):
    rows = play_rows(spark, sf_dir, "season", "epa")
    return grouped.above_group_quantile(rows, quantile=0.9)


@query(
    "pct_of_total",
    f"""SELECT {ORDER}, posteam, season, yards_gained, 100 * yards_gained
               / nullif(sum(yards_gained) OVER (PARTITION BY posteam, season), 0) AS yards_gained_pct_of_total
        FROM plays""",
    ["plays"],
    ["yards_gained_pct_of_total"],
)
def pct_of_total(spark, sf_dir):
    rows = play_rows(spark, sf_dir, *TEAM, "yards_gained")
    return grouped.pct_of_group_total(rows, "yards_gained", TEAM)


RANK = f"""
SELECT {ORDER}, season, epa, CASE WHEN epa IS NOT NULL THEN row_number() OVER (
         PARTITION BY season ORDER BY epa {{direction}} NULLS LAST, {ORDER}) END AS epa_rank
FROM plays
"""


@query("rank_in_season", RANK.format(direction="DESC"), ["plays"])
def rank_in_season(spark, sf_dir):
    return ordered.rank_within_group(settled_plays(spark, sf_dir, "season", "epa"), "epa", "season", PLAY_ORDER)


@query("rank_in_season_lowest_first", RANK.format(direction="ASC"), ["plays"])
def rank_in_season_lowest_first(spark, sf_dir):
    rows = settled_plays(spark, sf_dir, "season", "epa")
    return ordered.rank_within_group(rows, "epa", "season", PLAY_ORDER, descending=False)


# --- running and rolling -----------------------------------------------------------

RUNNING = f"""
SELECT {ORDER}, {{columns}}epa, CASE WHEN epa IS NOT NULL THEN sum(epa) OVER (
         {{partition}} ORDER BY {ORDER} ROWS UNBOUNDED PRECEDING) END AS cumulative_epa
FROM plays
"""


@query(
    "running_total",
    RUNNING.format(columns="posteam, season, ", partition="PARTITION BY posteam, season"),
    ["plays"],
    ["cumulative_epa"],
)
def running_total(spark, sf_dir):
    return ordered.cumulative_epa(settled_plays(spark, sf_dir, *TEAM, "epa"), PLAY_ORDER, TEAM)


@query("running_total_global", RUNNING.format(columns="", partition=""), ["plays"], ["cumulative_epa"])
def running_total_global(spark, sf_dir):
    """One running total over all plays, in blocks: no task sees them all."""
    return ordered.cumulative_epa(settled_plays(spark, sf_dir, "epa"), PLAY_ORDER)


@query(
    "running_value",
    """SELECT event_id, user_id, value, CAST(CASE WHEN value IS NOT NULL THEN
              sum(CAST(value AS DECIMAL(18, 2))) OVER (
                PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) END AS DOUBLE) AS value_so_far
       FROM events""",
)
def running_value(spark, sf_dir):
    """Running sum per user, in decimals: it comes out the same in whatever order it is added up."""
    events = surrogate.table(spark, sf_dir, "events").select(
        "event_id", "user_id", "ts", "value", F.col("value").cast("decimal(18, 2)").alias("exact")
    )
    summed = ordered.running_total(events, "exact", "value_so_far", "user_id", EVENT_ORDER)
    return summed.withColumn("value_so_far", F.col("value_so_far").cast("double")).drop("ts", "exact")


def rolling_sql(value: str, alias: str, rows: int, columns: str) -> str:
    frame = (
        f"OVER (PARTITION BY posteam, season ORDER BY {ORDER} ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"
    )
    return f"""SELECT {ORDER}, posteam, season, {columns},
                      CASE WHEN count({value}) {frame} >= 10 THEN avg({value}) {frame} END AS {alias}
               FROM plays"""


@query(
    "rolling_epa",
    rolling_sql("epa", "rolling_epa_50", 50, "epa"),
    ["plays"],
    ["rolling_epa_50"],
)
def rolling_epa(spark, sf_dir):
    return ordered.rolling_epa(settled_plays(spark, sf_dir, *TEAM, "epa"), TEAM, PLAY_ORDER)


@query(
    "rolling_success",
    rolling_sql("CAST(epa > 0 AS INT)", "rolling_success_rate_50", 50, "epa"),
    ["plays"],
    ["rolling_success_rate_50"],
)
def rolling_success(spark, sf_dir):
    return ordered.rolling_success_rate(settled_plays(spark, sf_dir, *TEAM, "epa"), TEAM, PLAY_ORDER)


@query(
    "rolling_pass_rate",
    rolling_sql("CAST(play_type = 'pass' AS INT)", "rolling_pass_rate_50", 50, "play_type"),
    ["plays"],
    ["rolling_pass_rate_50"],
)
def rolling_pass_rate(spark, sf_dir):
    return ordered.rolling_pass_rate(settled_plays(spark, sf_dir, *TEAM, "play_type"), TEAM, PLAY_ORDER)


@query(
    "rolling_yards",
    rolling_sql("yards_gained", "rolling_ypp_30", 30, "yards_gained"),
    ["plays"],
    ["rolling_ypp_30"],
)
def rolling_yards(spark, sf_dir):
    rows = settled_plays(spark, sf_dir, *TEAM, "yards_gained")
    return ordered.rolling_yards_per_play(rows, TEAM, PLAY_ORDER, window_size=30)


@query(
    "rolling_value",
    """SELECT event_id, user_id, value,
              CASE WHEN count(value) OVER w >= 3 THEN avg(value) OVER w END AS rolling_value_5
       FROM events
       WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""",
    doubles=["rolling_value_5"],
)
def rolling_value(spark, sf_dir):
    events = surrogate.table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    return ordered.rolling(
        events, F.col("value"), "rolling_value_5", 5, "user_id", EVENT_ORDER, min_values=3
    ).drop("ts")


@query(
    "rolling_corr",
    f"""SELECT {ORDER}, posteam, season, play_type, wp,
               CASE WHEN count(x) OVER w >= 20 AND min(x) OVER w < max(x) OVER w AND min(y) OVER w < max(y) OVER w
                    THEN corr(x, y) OVER w END AS pass_wp_correlation
        FROM (SELECT *, CASE WHEN wp IS NOT NULL THEN CAST(play_type = 'pass' AS INT) END AS x,
                     CASE WHEN play_type IS NOT NULL THEN wp END AS y FROM plays) AS p
        WINDOW w AS (PARTITION BY posteam, season ORDER BY {ORDER} ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)""",
    ["plays"],
    ["pass_wp_correlation"],
)
def rolling_corr(spark, sf_dir):
    rows = settled_plays(spark, sf_dir, *TEAM, "play_type", "wp")
    return ordered.pass_rate_wp_correlation(rows, TEAM, PLAY_ORDER)


# --- previous and next -------------------------------------------------------------


@query(
    "lag_value",
    """SELECT passer_id, season, total_epa,
              lag(total_epa, 2) OVER (PARTITION BY passer_id ORDER BY season) AS total_epa_lag2
       FROM stats""",
    ["plays"],
    ["total_epa", "total_epa_lag2"],
    ctes={"stats": STATS},
)
def lag_value(spark, sf_dir):
    stats = players.passer_seasons(surrogate.plays(spark, sf_dir), PLAY_ORDER)
    rows = settle(stats.select("passer_id", "season", "total_epa"))
    return ordered.lag_value(rows, "total_epa", ["season"], 2, "passer_id")


@query(
    "lead_value",
    """SELECT event_id, user_id, value,
              lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS "value_lag-1" FROM events""",
)
def lead_value(spark, sf_dir):
    events = surrogate.table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    return ordered.lag_value(events, "value", EVENT_ORDER, -1, "user_id").drop("ts")


@query(
    "lag_value_global",
    f"SELECT {ORDER}, epa, lag(epa, 3) OVER (ORDER BY {ORDER}) AS epa_lag3 FROM plays",
    ["plays"],
)
def lag_value_global(spark, sf_dir):
    """The value three plays earlier over all plays, across the borders of the chunks."""
    return ordered.lag_value(settled_plays(spark, sf_dir, "epa"), "epa", PLAY_ORDER, 3)


@query(
    "delta_previous",
    """SELECT event_id, user_id, value,
              value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS value_delta FROM events""",
    doubles=["value_delta"],
)
def delta_previous(spark, sf_dir):
    events = surrogate.table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    return ordered.delta_from_previous(events, "value", EVENT_ORDER, "user_id").drop("ts")


SEASON_ROWS = """
SELECT passer_id, season, coalesce(sum(epa), 0) AS epa, count(DISTINCT game_id) AS games,
       CAST(sum(complete_pass) AS BIGINT) AS rating
FROM plays WHERE play_type = 'pass' GROUP BY passer_id, season
"""


@query(
    "next_season_pairs",
    """SELECT a.passer_id, a.season, a.epa AS epa_current_season, b.epa AS epa_next_season,
              a.games AS games_current, b.games AS games_next, a.rating AS rating_current,
              b.rating AS rating_next, b.epa - a.epa AS epa_change, a.games - b.games AS games_lost,
              b.rating - a.rating AS rating_change
       FROM season_rows a JOIN season_rows b ON a.passer_id = b.passer_id AND a.season + 1 = b.season""",
    ["plays"],
    ["epa_current_season", "epa_next_season", "epa_change"],
    ctes={"season_rows": SEASON_ROWS},
)
def next_season_pairs(spark, sf_dir):
    """Each passer's season with the next one, and the changes between them."""
    plays = surrogate.plays(spark, sf_dir).filter(F.col("play_type") == "pass")
    rows = plays.groupBy("passer_id", "season").agg(
        F.coalesce(F.sum("epa"), F.lit(0)).alias("epa"),
        F.count_distinct("game_id").alias("games"),
        F.sum("complete_pass").alias("rating"),
    )
    columns = {
        "epa": ("epa_current_season", "epa_next_season"),
        "games": ("games_current", "games_next"),
        "rating": ("rating_current", "rating_next"),
    }
    return season_pairs(rows, "passer_id", columns).withColumns(next_season_changes())
