"""Registry of queries, and the pieces their SQL is put together from."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playmetrics.sources import surrogate

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# Doubles are compared at this many digits. The nudge keeps means such as 0.2328125, which lie
# halfway between two roundings, from falling to different sides in the two engines.
DIGITS = 6
NUDGE = 1e-9

VIEWS = {
    "plays": surrogate.oracle_view(surrogate.PLAYS_SQL),
    "games": surrogate.oracle_view(surrogate.GAMES_SQL),
    "ratings": surrogate.oracle_view(surrogate.RATINGS_SQL),
}


def query(
    name: str,
    sql: str | None = None,
    views: Sequence[str] = (),
    doubles: Sequence[str] = (),
    ctes: dict[str, str] | None = None,
) -> Callable[[Query], Query]:
    """Register a query. `views` and `ctes` become the WITH clause of the SQL, and `doubles`
    are rounded on both sides, since sums of doubles depend on their order."""

    def register(function: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(function(spark, sf_dir), doubles)

        QUERIES[name] = run
        if sql is not None:
            parts = {v: VIEWS[v] for v in views} | (ctes or {})
            text = sql
            if doubles:
                replaced = ", ".join(f"round({c} + {NUDGE}, {DIGITS}) + 0 AS {c}" for c in doubles)
                text = f"SELECT * REPLACE ({replaced}) FROM ({sql}) AS result"
            heads = ",\n".join(f"{n} AS (\n{body}\n)" for n, body in parts.items())
            SQL[name] = f"WITH {heads}\n{text}" if heads else text
        return function

    return register


def rounded(df: DataFrame, doubles: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c) + NUDGE, DIGITS) + F.lit(0.0) for c in doubles})
