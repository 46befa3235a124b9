"""Passer and rating queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from playmetrics.functions.codes import POSITION_CODES, RATINGS_TEAM_CODES, TEAM_CODES
from playmetrics.functions.scalars import (
    extract_first_last_name,
    letters_only_name,
    normalize_player_name,
    ratings_team_abbr,
    standardize_position,
    standardize_team_abbr,
)
from playmetrics.operators.sizing import scratch_path
from playmetrics.plans import players
from playmetrics.queries.base import DIGITS, query
from playmetrics.sources import sinks, surrogate
from playmetrics.sources.surrogate import PLAY_ORDER

# At the small scales a passer has few dropbacks a season.
MIN_DROPBACKS = 3

ORDER = ", ".join(PLAY_ORDER)

STATS = f"""
SELECT passer_id, season, count(*) AS dropbacks,
       CAST(sum(pass_attempt) AS BIGINT) AS attempts, CAST(sum(complete_pass) AS BIGINT) AS completions,
       coalesce(sum(passing_yards), 0) AS passing_yards,
       CAST(sum(pass_touchdown) AS BIGINT) AS touchdowns, CAST(sum(interception) AS BIGINT) AS interceptions,
       coalesce(sum(epa), 0) AS total_epa, avg(epa) AS epa_per_dropback,
       avg(CAST(epa > 0 AS INT)) AS success_rate, avg(cpoe) AS avg_cpoe,
       avg(air_yards) AS avg_air_yards, avg(yards_after_catch) AS avg_yac,
       max(posteam) FILTER (WHERE nth = 1) AS team, max(name) FILTER (WHERE nth = 1) AS player_name
FROM (SELECT *, row_number() OVER (PARTITION BY passer_id, season ORDER BY {ORDER}) AS nth
      FROM plays WHERE play_type = 'pass' AND passer_id IS NOT NULL) AS p
GROUP BY passer_id, season
"""
STATS_DOUBLES = ["total_epa", "epa_per_dropback", "success_rate", "avg_cpoe", "avg_air_yards", "avg_yac"]

RANKS = """
SELECT *,
       row_number() OVER (PARTITION BY season ORDER BY round(total_epa, 6) DESC NULLS LAST, passer_id) AS total_epa_rank,
       CASE WHEN epa_per_dropback IS NOT NULL THEN row_number() OVER (
         PARTITION BY season ORDER BY round(epa_per_dropback, 6) DESC NULLS LAST, passer_id) END AS epa_per_dropback_rank,
       CASE WHEN success_rate IS NOT NULL THEN row_number() OVER (
         PARTITION BY season ORDER BY round(success_rate, 6) DESC NULLS LAST, passer_id) END AS success_rate_rank,
       total_epa - lag(total_epa) OVER (PARTITION BY passer_id ORDER BY season) AS total_epa_delta,
       epa_per_dropback - lag(epa_per_dropback) OVER (PARTITION BY passer_id ORDER BY season) AS epa_per_dropback_delta
FROM stats
"""


def key_sql(name: str) -> str:
    """The name key, for texts in ASCII."""
    key = f"regexp_replace(upper({name}), '\\s+(JR\\.?|SR\\.?|III|II|IV|V)$', '')"
    key = f"regexp_replace({key}, '[''\\-\\.]', '', 'g')"
    key = f"regexp_replace({key}, '^\\s+|\\s+$', '', 'g')"
    key = f"regexp_replace({key}, '^(\\w)\\w*\\s+', '\\1')"
    return f"regexp_replace({key}, '\\s+', '', 'g')"


def case_sql(value: str, entries: dict[str, str], otherwise: str) -> str:
    branches = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in entries.items())
    return f"CASE {value} {branches} ELSE {otherwise} END"


def list_sql(values: list[str], index: str) -> str:
    return f"([{', '.join(repr(v) for v in values)}])[{index}]"


def pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index)


@query("qb_season_stats", STATS, ["plays"], STATS_DOUBLES)
def qb_season_stats(spark, sf_dir):
    return players.passer_seasons(surrogate.plays(spark, sf_dir), PLAY_ORDER)


@query(
    "qb_features",
    RANKS,
    ["plays"],
    [*STATS_DOUBLES, "total_epa_delta", "epa_per_dropback_delta"],
    ctes={"stats": STATS},
)
def qb_features(spark, sf_dir):
    return players.passer_features(surrogate.plays(spark, sf_dir), PLAY_ORDER, digits=DIGITS)


@query(
    "qualified_qbs",
    f"SELECT * FROM stats WHERE dropbacks >= {MIN_DROPBACKS}",
    ["plays"],
    STATS_DOUBLES,
    ctes={"stats": STATS},
)
def qualified_qbs(spark, sf_dir):
    return players.qualified_passers(surrogate.plays(spark, sf_dir), PLAY_ORDER, MIN_DROPBACKS)


@query(
    "rating_features",
    """SELECT team, season, avg(overall) AS avg_starter_ovr, max(overall) AS max_ovr, min(overall) AS min_ovr,
              max(overall) FILTER (WHERE position = 'QB') AS qb_ovr
       FROM ratings WHERE team IS NOT NULL GROUP BY team, season""",
    ["ratings"],
    ["avg_starter_ovr"],
)
def rating_features(spark, sf_dir):
    return players.rating_features(surrogate.ratings(spark, sf_dir))


@query(
    "clean_ratings",
    f"""SELECT *, {key_sql("player_name")} AS name_normalized,
               {case_sql("team", TEAM_CODES, "team")} AS team_std,
               {case_sql("upper(position)", POSITION_CODES, "position")} AS position_std
        FROM ratings""",
    ["ratings"],
)
def clean_ratings(spark, sf_dir):
    return players.clean_ratings(surrogate.ratings(spark, sf_dir))


@query(
    "clean_play_names",
    f"""SELECT {ORDER}, name, {key_sql("name")} AS name_normalized FROM plays""",
    ["plays"],
)
def clean_play_names(spark, sf_dir):
    rows = surrogate.plays(spark, sf_dir).select(*PLAY_ORDER, "name")
    return players.clean_names(rows)


@query(
    "name_parts",
    r"""SELECT player_name, nullif(regexp_extract(player_name, '^(\w+)', 1), '') AS first_name,
               nullif(regexp_extract(player_name, '\s(\w+)$', 1), '') AS last_name FROM ratings""",
    ["ratings"],
)
def name_parts(spark, sf_dir):
    first, last = extract_first_last_name("player_name")
    return surrogate.ratings(spark, sf_dir).select(
        "player_name", first.alias("first_name"), last.alias("last_name")
    )


@query(
    "letters_only_names",
    """SELECT player_name, trim(regexp_replace(upper(player_name), '[^A-Z ]', '', 'g')) AS name_clean
       FROM ratings""",
    ["ratings"],
)
def letters_only_names(spark, sf_dir):
    name = letters_only_name("player_name").alias("name_clean")
    return surrogate.ratings(spark, sf_dir).select("player_name", name)


CODES = [*TEAM_CODES, "KC", "LV"]


@query(
    "team_codes",
    f"""SELECT c_custkey, code, {case_sql("code", TEAM_CODES, "code")} AS team_std, code AS team_other,
               {case_sql("code", RATINGS_TEAM_CODES, "code")} AS ratings_code
        FROM (SELECT c_custkey, {list_sql(CODES, f"c_custkey % {len(CODES)} + 1")} AS code FROM customer) AS c""",
)
def team_codes(spark, sf_dir):
    """Every team code, each on many rows, to the standard and back."""
    index = (F.col("c_custkey") % len(CODES) + 1).cast("int")
    rows = surrogate.table(spark, sf_dir, "customer").select("c_custkey", pick(CODES, index).alias("code"))
    return rows.withColumns(
        {
            "team_std": standardize_team_abbr("code"),
            "team_other": standardize_team_abbr("code", source="plays"),
            "ratings_code": ratings_team_abbr("code"),
        }
    )


POSITIONS = [*POSITION_CODES, "Free Safety", "hb", "Long Snapper"]


@query(
    "position_codes",
    f"""SELECT p_partkey, position, {case_sql("upper(position)", POSITION_CODES, "position")} AS position_std
        FROM (SELECT p_partkey, {list_sql(POSITIONS, f"p_partkey % {len(POSITIONS)} + 1")} AS position FROM part) AS p""",
)
def position_codes(spark, sf_dir):
    index = (F.col("p_partkey") % len(POSITIONS) + 1).cast("int")
    rows = surrogate.table(spark, sf_dir, "part").select("p_partkey", pick(POSITIONS, index).alias("position"))
    return rows.withColumn("position_std", standardize_position("position"))


MATCH = f"""
SELECT r.season, r.team, r.player_name, r.overall, s.player_name AS passer_name, s.team AS passer_team,
       s.dropbacks, s.epa_per_dropback, s.total_epa
FROM ratings r JOIN stats s
  ON {key_sql("r.player_name")} = {key_sql("s.player_name")} AND r.season = s.season
WHERE r.position = 'QB' AND s.dropbacks >= {MIN_DROPBACKS}
"""
MATCH_COLUMNS = [
    "season", "team", "player_name", "overall", "passer_name", "passer_team", "dropbacks",
    "epa_per_dropback", "total_epa",
]


def matched(spark, sf_dir):
    ratings, plays = surrogate.ratings(spark, sf_dir), surrogate.plays(spark, sf_dir)
    return players.ratings_match(ratings, plays, PLAY_ORDER, MIN_DROPBACKS)


@query("ratings_match", MATCH, ["plays", "ratings"], ["epa_per_dropback", "total_epa"], ctes={"stats": STATS})
def ratings_match(spark, sf_dir):
    return matched(spark, sf_dir).select(*MATCH_COLUMNS)


@query(
    "ratings_correlation",
    """SELECT CASE WHEN min(overall) < max(overall) AND min(epa_per_dropback) < max(epa_per_dropback)
                   THEN corr(overall, epa_per_dropback) END AS ovr_vs_epa,
              CASE WHEN min(overall) < max(overall) AND min(total_epa) < max(total_epa)
                   THEN corr(overall, total_epa) END AS ovr_vs_total_epa
       FROM matched""",
    ["plays", "ratings"],
    ["ovr_vs_epa", "ovr_vs_total_epa"],
    ctes={"stats": STATS, "matched": MATCH},
)
def ratings_correlation(spark, sf_dir):
    return players.ratings_correlation(matched(spark, sf_dir))


@query(
    "roster_ratings",
    """SELECT team, max(overall) FILTER (WHERE position = 'QB') AS qb_ovr, avg(overall) AS avg_ovr,
              max(overall) AS max_ovr FROM ratings GROUP BY team""",
    ["ratings"],
    ["avg_ovr"],
)
def roster_ratings(spark, sf_dir):
    return players.team_roster_ratings(surrogate.ratings(spark, sf_dir), "position", "overall")


@query(
    "best_player_per_team",
    """SELECT season, team, position, player_name, overall FROM (
         SELECT *, row_number() OVER (PARTITION BY team ORDER BY overall DESC, player_name) AS nth
         FROM ratings WHERE position = 'QB') AS r WHERE nth = 1""",
    ["ratings"],
)
def best_player_per_team(spark, sf_dir):
    quarterbacks = surrogate.ratings(spark, sf_dir).filter(F.col("position") == "QB")
    return players.best_players(quarterbacks, "team", "overall", ["player_name"])


@query("ratings_from_csv", "SELECT * FROM ratings", ["ratings"])
def ratings_from_csv(spark, sf_dir):
    """Ratings written as CSV and read back with their schema."""
    path = scratch_path(spark, "ratings")
    return sinks.write_results(surrogate.ratings(spark, sf_dir), path, "csv")


@query(
    "name_keys",
    f"""SELECT {key_sql("player_name")} AS name_normalized, count(*) AS players FROM ratings GROUP BY 1""",
    ["ratings"],
)
def name_keys(spark, sf_dir):
    """Players per key: more than one means the key cannot tell them apart."""
    key = normalize_player_name("player_name").alias("name_normalized")
    return surrogate.ratings(spark, sf_dir).groupBy(key).agg(F.count(F.lit(1)).alias("players"))
