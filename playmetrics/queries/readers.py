"""Reader queries: stand-in files in the layout the loaders expect, read back under a season filter."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from playmetrics.functions.codes import FEATURE_MEANINGS
from playmetrics.functions.scalars import matchup_feature_columns
from playmetrics.operators.sizing import scratch_path
from playmetrics.plans import explanations, players
from playmetrics.queries.base import query
from playmetrics.queries.games import MATCHUP_CTES, MATCHUP_VIEWS
from playmetrics.queries.models import COMPLETE, training
from playmetrics.queries.people import STATS
from playmetrics.sources import schemas, sinks, surrogate, tables
from playmetrics.sources.surrogate import PLAY_ORDER

SEASONS = [1993, 1994, 1995, 1996]
WANTED = f"season IN ({', '.join(map(str, SEASONS))})"
PLAY_COLUMNS = [*PLAY_ORDER, "season", "posteam", "play_type", "epa"]
GAME_COLUMNS = ["game_id", "season", "game_type", "home_team", "away_team", "home_score", "away_score"]
ROSTER_COLUMNS = schemas.column_names(schemas.ROSTER)
RATING_COLUMNS = ["season", "player_name", "position", "team", "overall"]


@query("load_plays", f"SELECT {', '.join(PLAY_COLUMNS)} FROM plays WHERE {WANTED}", ["plays"])
def load_plays(spark, sf_dir):
    """Some seasons of a partitioned table; the smaller table that is asked for first is missing."""
    path = scratch_path(spark, "plays")
    sinks.write_seasons(surrogate.plays(spark, sf_dir).select(*PLAY_COLUMNS), path)
    return tables.load_plays(spark, f"{path}-small", SEASONS, full_path=path)


@query("load_schedules", f"SELECT {', '.join(GAME_COLUMNS)} FROM games WHERE {WANTED}", ["games"])
def load_schedules(spark, sf_dir):
    path = scratch_path(spark, "games")
    sinks.write_seasons(surrogate.games(spark, sf_dir).select(*GAME_COLUMNS), path)
    return tables.load_schedules(spark, path, SEASONS)


@query("load_players", "SELECT DISTINCT player_name, position, team FROM ratings", ["ratings"])
def load_players(spark, sf_dir):
    path = scratch_path(spark, "players")
    surrogate.ratings(spark, sf_dir).select("player_name", "position", "team").distinct().write.parquet(path)
    return tables.load_players(spark, path)


@query(
    "load_rosters",
    "SELECT player_name AS Player, position AS Pos, overall AS OVR, nullif(team, '') AS team FROM ratings",
    ["ratings"],
)
def load_rosters(spark, sf_dir):
    """A CSV folder per team; the team comes back from the folder's name."""
    path = scratch_path(spark, "rosters")
    named = {"Player": "player_name", "Pos": "position", "OVR": "overall"}
    kept = [F.col(named[c]) if c in named else F.lit(None).cast("int") for c in ROSTER_COLUMNS]
    rows = surrogate.ratings(spark, sf_dir).select(*[k.alias(c) for k, c in zip(kept, ROSTER_COLUMNS, strict=True)], "team")
    sinks.write_rosters(rows, path)
    return tables.load_team_rosters(spark, path).select("Player", "Pos", "OVR", "team")


@query(
    "load_tracking_stats",
    f"SELECT passer_id, season, attempts, avg_air_yards FROM stats WHERE {WANTED}",
    ["plays"],
    ["avg_air_yards"],
    ctes={"stats": STATS},
)
def load_tracking_stats(spark, sf_dir):
    path = scratch_path(spark, "tracking")
    stats = players.passer_seasons(surrogate.plays(spark, sf_dir), PLAY_ORDER)
    stats.select("passer_id", "season", "attempts", "avg_air_yards").write.parquet(f"{path}/nextgen_passing.parquet")
    return tables.load_tracking_stats(spark, path, "passing", SEASONS)


@query(
    "load_core",
    f"""SELECT 'plays' AS name, count(*) AS row_count FROM plays WHERE {WANTED}
        UNION ALL SELECT 'schedules', count(*) FROM games WHERE {WANTED}
        UNION ALL SELECT 'players', count(*) FROM ratings""",
    ["plays", "games", "ratings"],
)
def load_core(spark, sf_dir):
    """Rows of each of the three core tables."""
    path = scratch_path(spark, "core")
    sinks.write_seasons(surrogate.plays(spark, sf_dir).select(*PLAY_COLUMNS), f"{path}/plays")
    sinks.write_seasons(surrogate.games(spark, sf_dir).select(*GAME_COLUMNS), f"{path}/games")
    surrogate.ratings(spark, sf_dir).select("player_name", "position").write.parquet(f"{path}/players")
    core = tables.load_core(spark, f"{path}/plays", f"{path}/games", f"{path}/players", SEASONS)
    counts = [df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("row_count")) for name, df in core.items()]
    return reduce(lambda a, b: a.unionByName(b), counts)


@query("load_ratings", f"SELECT {', '.join(RATING_COLUMNS)} FROM ratings", ["ratings"])
def load_ratings(spark, sf_dir):
    """Ratings from CSV in the declared schema; columns that have no stand-in are empty."""
    path = scratch_path(spark, "ratings")
    known = surrogate.ratings(spark, sf_dir)
    empty = spark.createDataFrame([], schemas.RATINGS)
    full = known.select(
        *[
            F.col(f.name).cast(f.dataType) if f.name in known.columns else F.lit(None).cast(f.dataType).alias(f.name)
            for f in empty.schema
        ]
    )
    full.write.options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return tables.load_ratings(spark, path).select(*RATING_COLUMNS)


KINDS = {"game_id": "bigint", "season": "int", "posteam": "string", "play_type": "string", "epa": "double"}


@query(
    "schema_rows",
    "\nUNION ALL\n".join(f"SELECT '{c}' AS name, '{k}' AS kind, count({c}) AS known FROM plays" for c, k in KINDS.items()),
    ["plays"],
)
def schema_rows(spark, sf_dir):
    """Columns with their types, and how many values of each are known."""
    rows = surrogate.plays(spark, sf_dir).select(*KINDS)
    cells = [
        F.struct(F.lit(c).alias("name"), F.lit(kind).alias("kind"), F.count(c).alias("known"))
        for c, kind in tables.schema_rows(rows)
    ]
    return rows.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


MEANINGS = ", ".join(
    "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in (f, *m)) + ")" for f, m in FEATURE_MEANINGS.items()
)


@query(
    "feature_dictionary",
    "SELECT m.*, f.mean FROM (VALUES "
    + MEANINGS
    + ") AS m(feature, name, description, positive, negative) LEFT JOIN means f ON f.feature = m.feature",
    MATCHUP_VIEWS,
    ["mean"],
    ctes={
        **MATCHUP_CTES,
        "complete": COMPLETE,
        "means": "\nUNION ALL\n".join(
            f"SELECT '{f}' AS feature, avg({f}) AS mean FROM complete" for f in matchup_feature_columns()
        ),
    },
)
def feature_dictionary(spark, sf_dir):
    """The dictionary with the mean of each feature over all complete matchups."""
    features = matchup_feature_columns()
    cells = [F.struct(F.lit(f).alias("feature"), F.avg(f).alias("mean")) for f in features]
    means = training(spark, sf_dir).agg(F.array(*cells).alias("cells")).select(F.inline("cells"))
    return explanations.feature_dictionary(spark).join(means, "feature", "left")
