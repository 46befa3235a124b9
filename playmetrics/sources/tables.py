"""Readers for plays, games, players, tracking stats, ratings and rosters.

Parquet keeps its own schema and CSV gets a declared one. A season filter is a plain
predicate: it prunes folders when the table is partitioned by season, and row groups
otherwise. Without seasons every season is read.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playmetrics.sources import schemas

# CSV keeps blanks at the ends of a text only if asked to.
KEEP_BLANKS = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}

# Spark's folder for rows whose partition value is NULL or empty.
UNKNOWN_TEAM = "__HIVE_DEFAULT_PARTITION__"

TRACKING_TYPES = ("passing", "rushing", "receiving")


def only_seasons(df: DataFrame, seasons: Iterable[int] | None) -> DataFrame:
    return df if seasons is None else df.filter(F.col("season").isin(*seasons))


def first_table(spark: SparkSession, paths: Sequence[str], schema: str | None = None) -> DataFrame:
    """The first of the Parquet tables that exists."""
    for i, path in enumerate(paths):
        reader = spark.read if schema is None else spark.read.schema(schema)
        try:
            return reader.parquet(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND" or i == len(paths) - 1:
                raise
    raise ValueError("no paths given")


def load_plays(
    spark: SparkSession,
    path: str,
    seasons: Iterable[int] | None = None,
    schema: str | None = None,
    full_path: str | None = None,
) -> DataFrame:
    """The plays at `path` (often a table of few columns), or those at `full_path` if it is missing."""
    paths = [path] if full_path is None else [path, full_path]
    return only_seasons(first_table(spark, paths, schema), seasons)


def load_schedules(
    spark: SparkSession, path: str, seasons: Iterable[int] | None = None, schema: str | None = None
) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return only_seasons(reader.parquet(path), seasons)


def load_players(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def load_tracking_stats(
    spark: SparkSession, path: str, stat_type: str = "passing", seasons: Iterable[int] | None = None
) -> DataFrame:
    """One table per type, at `path/nextgen_<type>.parquet`."""
    if stat_type not in TRACKING_TYPES:
        raise ValueError(f"stat_type must be one of {list(TRACKING_TYPES)}")
    return only_seasons(spark.read.parquet(f"{path}/nextgen_{stat_type}.parquet"), seasons)


def final_games(schedules: DataFrame) -> DataFrame:
    return schedules.filter(F.col("game_type") == "SB")


def load_core(
    spark: SparkSession,
    plays_path: str,
    schedules_path: str,
    players_path: str,
    seasons: Sequence[int] | None = None,
    views: bool = False,
) -> dict[str, DataFrame]:
    """Plays, schedules and players by name; with `views` also as temporary views."""
    tables = {
        "plays": load_plays(spark, plays_path, seasons),
        "schedules": load_schedules(spark, schedules_path, seasons),
        "players": load_players(spark, players_path),
    }
    if views:
        for name, df in tables.items():
            df.createOrReplaceTempView(name)
    return tables


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: str) -> DataFrame:
    paths = path if isinstance(path, str) else list(path)
    return spark.read.option("header", True).schema(schema).csv(paths)


def load_ratings(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.RATINGS)


def decoded(path: Column) -> Column:
    """A path of `_metadata` as it was named; a plus sign stands for itself there."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def load_rosters(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Rosters have no team column: the file name ends in ` - <team>.csv` or is `<team>.csv`."""
    file_name = decoded(F.col("_metadata.file_name"))
    team = F.regexp_extract(file_name, r"^(?:.* - )?(.+)\.csv\z", 1)
    rosters = read_csv(spark, paths, schemas.ROSTER)
    return rosters.select("*", F.trim(team).alias("team"))


def load_team_rosters(spark: SparkSession, path: str) -> DataFrame:
    """Rosters that `sinks.write_rosters` left: the team is the name of the folder that a row's file lies in.

    It is read as text, whatever it looks like; the folder for unknown teams gives NULL.
    """
    folder = F.regexp_extract(decoded(F.col("_metadata.file_path")), r"/team=([^/]*)/[^/]*\z", 1)
    rows = spark.read.option("header", True).option("recursiveFileLookup", True).options(**KEEP_BLANKS)
    team = F.when(folder != UNKNOWN_TEAM, decoded(folder))
    return rows.schema(schemas.ROSTER).csv(path).select("*", team.alias("team"))


def schema_rows(df: DataFrame) -> list[tuple[str, str]]:
    """Column names and types, known without reading data."""
    return df.dtypes
