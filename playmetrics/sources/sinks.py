"""Writers: season-partitioned tables, the season merge, and result files.

Rows are rebalanced by season before they are written: without that each task would write
a file into each season's folder. Unlike a plain repartition this lets AQE cut a season that
holds a third of all rows into many tasks, and put small seasons together.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playmetrics.sources import schemas
from playmetrics.sources.tables import KEEP_BLANKS


def by_season(df: DataFrame, season: str) -> DataFrame:
    return df.hint("rebalance", season)


def write_seasons(df: DataFrame, path: str, season: str = "season") -> DataFrame:
    """Write the table partitioned by season and return it read back."""
    by_season(df, season).write.mode("overwrite").partitionBy(season).parquet(path)
    return df.sparkSession.read.parquet(path)


def merge_seasons(spark: SparkSession, path: str, new: DataFrame, season: str = "season") -> DataFrame:
    """Replace the seasons of `new` in a table written by `write_seasons`; others stay untouched.

    New columns are cast to the stored types; columns unknown to the table are dropped, with a warning that
    names them.
    A table cannot lose a column this way: where `new` lacks one, build the table anew from
    `replace_seasons` at another path.
    """
    stored = spark.read.parquet(path)
    missing = [c for c in stored.columns if c not in new.columns]
    if missing:
        raise ValueError(f"the new rows lack stored columns: {missing}")
    unknown = [c for c in new.columns if c not in stored.columns]
    if unknown:
        warnings.warn(f"columns unknown to the stored table are dropped: {unknown}", stacklevel=2)
    aligned = new.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in stored.schema])
    (
        by_season(aligned, season)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(season)
        .parquet(path)
    )
    return spark.read.parquet(path)


def write_rosters(rosters: DataFrame, path: str) -> None:
    """Rosters as CSV with a folder per team, which is where a reader finds the team again. Rows are
    rebalanced by team first, so a team with a third of all rows is written by many tasks."""
    rows = rosters.select(*schemas.column_names(schemas.ROSTER), F.col("team").cast("string").alias("team")).hint("rebalance", "team")
    rows.write.mode("overwrite").options(header=True, **KEEP_BLANKS).partitionBy("team").csv(path)


def write_results(df: DataFrame, path: str, file_format: str = "parquet") -> DataFrame:
    """Write a result table (predictions, importances) as Parquet or CSV and read it back."""
    if file_format == "csv":
        # By default the CSV writer trims blanks, which are part of a name here.
        df.write.mode("overwrite").options(header=True, **KEEP_BLANKS).csv(path)
        return df.sparkSession.read.options(header=True).schema(df.schema).csv(path)
    df.write.mode("overwrite").format(file_format).save(path)
    return df.sparkSession.read.format(file_format).load(path)
