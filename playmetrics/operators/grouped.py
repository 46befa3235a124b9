"""Compare each row with a figure of its group.

The figure is aggregated first (combining on the map side) and joined back, so a group with
a third of all rows never sits in one window partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playmetrics.operators.ordered import names, running_total
from playmetrics.operators.sizing import GROUP_ROWS, attach, settle_table


def above_group_mean(
    df: DataFrame,
    value: str = "epa",
    group: str | Sequence[str] = "season",
    alias: str = "epa_above_avg",
    **options,
) -> DataFrame:
    """Value minus the mean of its group."""
    keys = names(group)
    means = df.groupBy(*keys).agg(F.avg(value).alias("__mean"))
    joined = attach(df, means, keys, **options)
    return joined.withColumn(alias, F.col(value) - F.col("__mean")).drop("__mean")


def pct_of_group_total(df: DataFrame, value: str, group: str | Sequence[str], **options) -> DataFrame:
    """Value as percent of its group's sum; NULL where the sum is 0."""
    keys = names(group)
    totals = df.groupBy(*keys).agg(F.sum(value).alias("__total"))
    share = F.try_divide(F.col(value), F.col("__total")) * 100
    return attach(df, totals, keys, **options).withColumn(f"{value}_pct_of_total", share).drop("__total")


def value_counts(df: DataFrame, value: str, keys: Sequence[str], group_limit: int = GROUP_ROWS) -> DataFrame:
    """Distinct values of each group with their count, running count and the group's count."""
    counts = settle_table(
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("__rows")),
        "values",
    )
    sizes = counts.groupBy(*keys).agg(F.sum("__rows").alias("__n"))
    running = running_total(counts, "__rows", "__upto", keys, [value], group_limit=group_limit)
    return attach(running, sizes, keys) if keys else running.withColumn("__n", sizes.scalar())


def nearest_quantile(
    df: DataFrame, value: str, group: str | Sequence[str], quantile: float, alias: str, **options
) -> DataFrame:
    """One row per group: the value at 1-based position floor(q * (n - 1) + 0.5) + 1."""
    keys = names(group)
    position = F.floor(F.lit(float(quantile)) * (F.col("__n") - 1) + 0.5) + 1
    reached = F.when(F.col("__upto") >= position, F.col(value))
    return value_counts(df, value, keys, **options).groupBy(*keys).agg(F.min(reached).alias(alias))


def linear_quantiles(
    df: DataFrame, value: str, group: str | Sequence[str], quantiles: dict[str, float], **options
) -> DataFrame:
    """One row per group: quantiles interpolated between the two neighbouring values."""
    keys = names(group)

    def value_at(position):
        return F.min(F.when(F.col("__upto") > position, F.col(value)))

    def interpolated(q: float):
        place = F.lit(float(q)) * (F.col("__n") - 1)
        low, high = value_at(F.floor(place)), value_at(F.ceil(place))
        part = F.max(place - F.floor(place))
        return low + (high - low) * part

    figures = [interpolated(q).alias(a) for a, q in quantiles.items()]
    return value_counts(df, value, keys, **options).groupBy(*keys).agg(*figures)


def above_group_quantile(
    df: DataFrame,
    value: str = "epa",
    group: str | Sequence[str] = "season",
    quantile: float = 0.5,
    alias: str | None = None,
    **options,
) -> DataFrame:
    """Whether the value is above its group's quantile; the column name truncates `quantile * 100`."""
    keys = names(group)
    alias = alias or f"epa_above_p{int(quantile * 100)}"
    thresholds = nearest_quantile(df, value, keys, quantile, "__threshold", **options)
    joined = attach(df, thresholds, keys)
    return joined.withColumn(alias, F.col(value) > F.col("__threshold")).drop("__threshold")
