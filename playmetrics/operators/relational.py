"""Set operations, season pairs, top rows and small table helpers."""

from __future__ import annotations

from collections.abc import Collection, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from playmetrics.operators.ordered import names
from playmetrics.operators.sizing import same_keys, settle, small_enough


def drop_missing(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    """Drop rows with a NULL in the subset. NaN is a value and stays (`dropna` drops it)."""
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in subset], F.lit(True))
    return df.filter(known)


def prefix_columns(df: DataFrame, prefix: str, keep: Collection[str]) -> DataFrame:
    return df.withColumnsRenamed({c: f"{prefix}{c}" for c in df.columns if c not in keep})


def common_columns(left: DataFrame, right: DataFrame) -> list[str]:
    return sorted(set(left.columns) & set(right.columns))


def shared_type(left: T.DataType, right: T.DataType) -> T.DataType | None:
    """The type both sides are cast to before a union, where Spark's own widening differs:
    text wins over every other type, a number over a boolean."""
    if left == right:
        return None
    for a, b in ((left, right), (right, left)):
        if isinstance(a, T.StringType):
            return a
        if isinstance(a, T.NumericType) and isinstance(b, T.BooleanType):
            return a
    return None


def union_on_common(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of both frames on their common columns, in name order, at the wider type."""
    columns = common_columns(left, right)

    def aligned(df: DataFrame, other: DataFrame) -> DataFrame:
        def cast(c: str) -> Column:
            wider = shared_type(df.schema[c].dataType, other.schema[c].dataType)
            return F.col(c) if wider is None else F.col(c).cast(wider).alias(c)

        return df.select(*[cast(c) for c in columns])

    return aligned(left, right).unionByName(aligned(right, left))


def replace_seasons(stored: DataFrame, new: DataFrame, season: str = "season") -> DataFrame:
    """All rows of `new`, and the stored rows of every season that `new` does not have."""
    seasons = settle(new.select(F.col(season).alias("__season")).distinct())
    if small_enough(seasons):
        seasons = F.broadcast(seasons)
    kept = stored.join(seasons, stored[season] == seasons["__season"], "left_anti")
    return union_on_common(kept, new)


def season_pairs(df: DataFrame, entity: str, columns: dict[str, tuple[str, str]], season: str = "season") -> DataFrame:
    """Pair each season of an entity with its next one.

    `columns` maps a column to its two names, of this and of the next season.
    """
    this = df.select(entity, season, *[F.col(c).alias(a) for c, (a, _) in columns.items()])
    following = df.select(
        F.col(entity).alias("__entity"),
        (F.col(season) - 1).alias("__season"),
        *[F.col(c).alias(b) for c, (_, b) in columns.items()],
    )
    same = (this[entity] == following["__entity"]) & (this[season] == following["__season"])
    return this.join(following, same, "inner").drop("__entity", "__season")


def head(df: DataFrame, order_by: Sequence[str | Column], n: int) -> DataFrame:
    return df.orderBy(*order_by).limit(n)


def tail(df: DataFrame, order_by: Sequence[str], n: int) -> DataFrame:
    """The last `n` rows of the order, in that order."""
    return df.orderBy(*[F.col(c).desc() for c in order_by]).limit(n).orderBy(*order_by)


def best_per_group(
    df: DataFrame, group: str | Sequence[str], value: str, ties: Sequence[str]
) -> DataFrame:
    """The row with the largest value per group, the first by `ties` among equals.

    An aggregate rather than a window: it combines on the map side, so one huge group is
    no problem. Rows without a value come last, as in a descending sort.
    """
    keys = names(group)
    rest = [c for c in df.columns if c not in keys]
    best_first = F.struct(F.isnull(value), F.negative(value), *[F.col(c) for c in ties])
    row = F.min_by(F.struct(*rest), best_first)
    return df.groupBy(*keys).agg(row.alias("__row")).select(*keys, "__row.*").select(*df.columns)


def rows_without(df: DataFrame, excluded: DataFrame | None, key: str) -> DataFrame:
    """Anti-join; NULL `excluded` keeps every row."""
    if excluded is None:
        return df
    keys = excluded.select(F.col(key).alias("__excluded")).distinct()
    return df.join(keys, same_keys(df, keys, {key: "__excluded"}), "left_anti")
