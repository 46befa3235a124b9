"""The figures behind the charts: fits, outliers, digit matrix, boxes, histogram, correlations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from playmetrics.operators.grouped import linear_quantiles
from playmetrics.operators.ordered import names
from playmetrics.operators.sizing import attach, settle, settle_table


def line_fit(x: str, y: str) -> Column:
    """Least-squares line over complete pairs as (slope, intercept); NULL for two points or fewer."""
    line = F.struct(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept")
    )
    return F.when(F.regr_count(y, x) > 2, line)


def height(line: Column, x: str) -> Column:
    return line["slope"] * F.col(x) + line["intercept"]


def trend(df: DataFrame, x: str = "season", y: str = "epa_per_play", alias: str = "trend") -> DataFrame:
    """Add the height of the common trend line at each row."""
    line = df.agg(line_fit(x, y).alias("__line")).scalar()
    return df.withColumn("__line", line).withColumn(alias, height(F.col("__line"), x)).drop("__line")


def trend_by_group(
    df: DataFrame, group: str | Sequence[str], x: str, y: str, alias: str = "trend"
) -> DataFrame:
    """Add the height of the group's own trend line at each row."""
    keys = names(group)
    lines = df.groupBy(*keys).agg(line_fit(x, y).alias("__line"))
    return attach(df, lines, keys).withColumn(alias, height(F.col("__line"), x)).drop("__line")


def outliers(
    df: DataFrame,
    x: str,
    y: str,
    ties: Sequence[str],
    n: int = 10,
    alias: str = "residual",
    digits: int | None = None,
) -> DataFrame:
    """The `n` rows farthest from the trend line. Rows without x or y take no slot, and equal
    distances (with `digits`: equal when rounded) are ordered by `ties`."""
    complete = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    far = F.abs(F.col(y) - F.col("__trend"))
    measured = trend(complete, x, y, "__trend").withColumn(alias, far).drop("__trend")
    compared = F.col(alias) if digits is None else F.round(alias, digits)
    ordered = measured.filter(F.col(alias).isNotNull()).orderBy(compared.desc(), *ties)
    return ordered.limit(n)


def digit_matrix(
    df: DataFrame, home_digit: str = "home_digit", away_digit: str = "away_digit"
) -> DataFrame:
    """Percent of games per pair of final digits, all hundred pairs, 0 where none occurred."""
    counts = settle(df.groupBy(home_digit, away_digit).agg(F.count(F.lit(1)).alias("__games")))
    total = counts.agg(F.sum("__games").alias("__all")).scalar()
    cells = df.sparkSession.range(100).select(
        F.floor(F.col("id") / 10).cast("int").alias("__home"),
        F.pmod("id", F.lit(10)).cast("int").alias("__away"),
    )
    same = (cells["__home"] == counts[home_digit]) & (cells["__away"] == counts[away_digit])
    # A hundred cells at most have counts.
    found = counts.filter(counts[home_digit].between(0, 9) & counts[away_digit].between(0, 9))
    return cells.join(F.broadcast(found), same, "left").select(
        F.col("__home").alias(home_digit),
        F.col("__away").alias(away_digit),
        F.coalesce(F.col("__games"), F.lit(0)).alias("count"),
        F.coalesce(F.try_divide(F.col("__games"), total) * 100, F.lit(0.0)).alias("percent"),
    )


BOX = {"low": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "high": 1.0}


def box_stats(df: DataFrame, value: str, group: str | Sequence[str], **options) -> DataFrame:
    """Minimum, quartiles and maximum per group, with linear interpolation."""
    return linear_quantiles(df, value, group, BOX, **options)


def histogram(
    df: DataFrame, value: str, bins: int = 30, group: str | Sequence[str] | None = None
) -> DataFrame:
    """Rows per bin. The bins are equal between the smallest and the largest value, the last
    one closed; with a single distinct value there is one bin.

    The input is read once, to count its values; the range and the bins come from the counts.
    """
    keys = names(group)
    known = df.select(*keys, F.col(value).alias("__value")).filter("__value IS NOT NULL")
    counts = settle_table(known.groupBy(*keys, "__value").agg(F.count(F.lit(1)).alias("__n")), "values")
    number = F.col("__value").cast("double")
    ends = counts.agg(F.min("__value").cast("double").alias("low"), F.max("__value").cast("double").alias("high")).first()
    low, high = F.lit(ends["low"]).cast("double"), F.lit(ends["high"]).cast("double")
    width = (high - low) / bins
    bucket = F.least(F.width_bucket(number, low, high, F.lit(bins)), F.lit(bins))
    binned = counts.select(*keys, F.when(low < high, bucket).otherwise(F.lit(1)).cast("int").alias("bin"), "__n")
    found = binned.groupBy(*keys, "bin").agg(F.sum("__n").alias("rows"))
    return found.select(
        *keys, "bin", (low + (F.col("bin") - 1) * width).alias("bin_start"), (low + F.col("bin") * width).alias("bin_end"), "rows"
    )


# Columns whose presence one long records.
FLAGS = 60


def co_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """What correlations need, per pair of columns and set of columns that a row has: pair, n, mean_x, mean_y, xx,
    yy, xy (sums of squared and mixed deviations from the means), min_x, max_x, min_y, max_y.

    One aggregate, whose groups are the sets of known columns: inside a set every pair is complete, so means,
    ranges and squares are kept once per column and a pair needs a single sum of products. Rows of this table
    can be merged with `merged_moments`, from any number of tables.
    """
    given = [F.col(c).cast("double").alias(f"__c{i}") for i, c in enumerate(columns)]
    words = range(-(-len(columns) // FLAGS))
    sets = [
        reduce(
            lambda a, b: a + b,
            [F.when(F.col(c).isNotNull(), 1 << (i % FLAGS)).otherwise(0).cast("long") for i, c in enumerate(columns) if i // FLAGS == w],
        ).alias(f"__set{w}")
        for w in words
    ]
    rows = df.select(*given, *sets)
    one = [F.col(f"__c{i}") for i in range(len(columns))]
    pairs = list(combinations_with_replacement(range(len(columns)), 2))
    table = rows.groupBy(*[f"__set{w}" for w in words]).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.array(*map(F.avg, one)).alias("means"),
        F.array(*map(F.min, one)).alias("lows"), F.array(*map(F.max, one)).alias("highs"),
        F.array(*[F.covar_pop(one[i], one[j]) for i, j in pairs]).alias("products"),
    )

    # Places in the arrays, looked up per row: a few short expressions instead of some for each pair.
    size = len(columns)
    places = {tuple(sorted((i, j))): k for k, (i, j) in enumerate(pairs)}
    numbers = {"x": [i for i, _ in pairs], "y": [j for _, j in pairs]}
    numbers |= {f"{c}{c}": [places[i, i] for i in numbers[c]] for c in "xy"}
    at = table.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(len(pairs) - 1))))
    at = at.withColumns({f"__{c}": F.get(F.array(*map(F.lit, ks)), "__k") for c, ks in numbers.items()})
    n = F.col("n")
    figures = at.select(
        (F.col("__x") * size + F.col("__y")).alias("pair"), n, F.get("means", "__x").alias("mean_x"), F.get("means", "__y").alias("mean_y"),
        (F.get("products", "__xx") * n).alias("xx"), (F.get("products", "__yy") * n).alias("yy"), (F.get("products", "__k") * n).alias("xy"),
        F.get("lows", "__x").alias("min_x"), F.get("highs", "__x").alias("max_x"),
        F.get("lows", "__y").alias("min_y"), F.get("highs", "__y").alias("max_y"),
    )
    # Pairs of which the set lacks a side have no rows there.
    return figures.filter("mean_x IS NOT NULL AND mean_y IS NOT NULL")


def merged_moments(parts: DataFrame) -> DataFrame:
    """One row per pair from all its parts: deviations are moved to the mean of the whole."""
    pair = W.partitionBy("pair")
    whole = F.sum("n").over(pair)
    placed = parts.withColumns(
        {"__x": F.col("mean_x") - F.sum(F.col("n") * F.col("mean_x")).over(pair) / whole,
         "__y": F.col("mean_y") - F.sum(F.col("n") * F.col("mean_y")).over(pair) / whole}
    )
    n, x, y = F.col("n"), F.col("__x"), F.col("__y")
    return placed.groupBy("pair").agg(
        F.sum(n).alias("n"), F.sum(F.col("xx") + n * x * x).alias("xx"), F.sum(F.col("yy") + n * y * y).alias("yy"),
        F.sum(F.col("xy") + n * x * y).alias("xy"), F.min("min_x").alias("min_x"), F.max("max_x").alias("max_x"),
        F.min("min_y").alias("min_y"), F.max("max_y").alias("max_y"),
    )


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Correlations over pairwise complete rows in long form, from a single aggregate over the rows.

    NULL if a side is constant over the pair's rows, or there are none. The diagonal is 1 for a column
    that varies, as a correlation with itself is.
    """
    k = len(columns)
    moments = merged_moments(co_moments(df, columns))
    varies = (F.col("min_x") < F.col("max_x")) & (F.col("min_y") < F.col("max_y"))
    own = F.col("pair") % (k + 1) == 0
    value = F.when(own, F.lit(1.0)).otherwise(F.try_divide(F.col("xy"), F.sqrt("xx") * F.sqrt("yy")))
    found = moments.select("pair", F.when(varies, value).alias("correlation"))
    cells = [(i, j, min(i, j) * k + max(i, j)) for i in range(k) for j in range(k)]
    rows = [(columns[i], columns[j], pair) for i, j, pair in cells]
    # As many rows as the matrix has cells.
    matrix = df.sparkSession.createDataFrame(rows, "x string, y string, pair int")
    return matrix.join(F.broadcast(found), "pair", "left").select("x", "y", "correlation")


def series(df: DataFrame, x: str, y: str, group: str | list[str] | None = None) -> DataFrame:
    """x, y and the optional group columns, in drawing order."""
    keys = names(group)
    return df.select(*keys, x, y).orderBy(*keys, x)


def winner_loser_rows(games: DataFrame, home_value: str, away_value: str, alias: str) -> DataFrame:
    """Two rows per decided game: the winner's value and the loser's. Games without scores have none."""
    games = games.filter("home_score IS NOT NULL AND away_score IS NOT NULL")
    home_won = F.col("home_score") > F.col("away_score")
    sides = F.array(
        F.struct(
            F.when(home_won, "Winner").otherwise("Loser").alias("result"),
            F.col(home_value).alias(alias),
        ),
        F.struct(
            F.when(home_won, "Loser").otherwise("Winner").alias("result"),
            F.col(away_value).alias(alias),
        ),
    )
    return games.select("game_id", F.inline(sides))
