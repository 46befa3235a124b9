"""Operators that depend on row order, safe for groups of any size.

Spark rows have no order, so each operator takes `order_by`; it should be a total order
within a group. Groups that fit a task get a plain window. The rows of groups that do not
are range-partitioned on (group, order) instead, so that a group is spread over many blocks:

* running sums and positions are taken inside a block, and the totals of the group's
  earlier blocks are added. Only groups that cross a block border have such totals, so
  there are fewer of them than blocks.
* frames of a known reach (rolling, lag) run over chunks of consecutive positions. Each
  chunk also gets copies of the few rows its first and last frames reach into.

Either way no rows are left out and the results are the same, up to the last bits of sums
of doubles.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from playmetrics.operators.sizing import (
    GROUP_ROWS,
    attach,
    large_groups,
    same_keys,
    settle_table,
    small_enough,
)

# A block is worth a task of its own from here on.
BLOCK_ROWS = 5_000

# Rows per chunk once a group is split; a window wider than that makes the chunks wider.
CHUNK_ROWS = 50_000

BLOCK, SEQ, POSITION, CHUNK = "__block", "__seq", "__position", "__chunk"

Order = Sequence[str | Column]


def names(keys: str | Sequence[str] | None) -> list[str]:
    if keys is None:
        return []
    return [keys] if isinstance(keys, str) else list(keys)


def by_group_size(
    df: DataFrame,
    keys: Sequence[str],
    group_limit: int,
    plain: Callable[[DataFrame], DataFrame],
    split: Callable[[DataFrame, int], DataFrame],
) -> DataFrame:
    """`plain` for the rows of groups up to the limit, `split` (given the row count) for the rest."""
    if not keys:
        return split(df, df.count())
    large = large_groups(df, keys, group_limit)
    large_rows = large.agg(F.sum("__size").alias("rows")).first()["rows"]
    if not large_rows:
        return plain(df)
    if not small_enough(large):
        return split(df, df.count())
    renamed = {c: f"__key_{c}" for c in keys}
    side = F.broadcast(large.drop("__size").withColumnsRenamed(renamed))
    same = same_keys(df, side, renamed)
    fitting, hot = df.join(side, same, "left_anti"), df.join(side, same, "left_semi")
    return plain(fitting).unionByName(split(hot, large_rows))


def blocks(df: DataFrame, keys: Sequence[str], order_by: Order, rows: int, group_limit: int) -> DataFrame:
    """Range-partition on (keys, order) and number partitions and the rows inside them."""
    parallel = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(min(parallel, rows // BLOCK_ROWS + 1), rows // group_limit + 1)
    sort = [*keys, *order_by]
    numbered = (
        df.repartitionByRange(n, *sort)
        .sortWithinPartitions(*sort)
        .withColumn(SEQ, F.monotonically_increasing_id())
        .withColumn(BLOCK, F.shiftright(F.col(SEQ), 33))
    )
    # Range borders are sampled: write them down, as two branches below must see the same ones.
    return settle_table(numbered, "blocks")


def earlier_blocks(blocked: DataFrame, keys: Sequence[str], totals: dict[str, Column]) -> DataFrame:
    """Per (group, block): the totals over the group's earlier blocks, where it has any."""
    before = W.partitionBy(*keys).orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)
    per_block = blocked.groupBy(*keys, BLOCK).agg(*[t.alias(a) for a, t in totals.items()])
    return per_block.select(
        *keys,
        BLOCK,
        F.row_number().over(W.partitionBy(*keys).orderBy(BLOCK)).alias("__nth"),
        *[F.sum(a).over(before).alias(a) for a in totals],
    ).filter(F.col("__nth") > 1).drop("__nth")


def add_earlier(blocked: DataFrame, keys: Sequence[str], totals: dict[str, Column]) -> DataFrame:
    """Join the earlier totals on. At most one group crosses each block border, so the
    joined side has fewer rows than there are blocks; its size is checked all the same."""
    return attach(blocked, earlier_blocks(blocked, keys, totals), [*keys, BLOCK])


def with_positions(
    df: DataFrame, keys: Sequence[str], order_by: Order, rows: int, group_limit: int
) -> DataFrame:
    """Add the 1-based position in the group, without holding a group in one task.

    A group's rows follow each other in its blocks. So a position is the row's distance from
    the group's first row in the block, plus the group's rows in earlier blocks: two figures
    per group and block, joined on. The rows are not shuffled again.
    """
    blocked = blocks(df, keys, order_by, rows, group_limit)
    before = W.partitionBy(*keys).orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)
    starts = (
        blocked.groupBy(*keys, BLOCK)
        .agg(F.min(SEQ).alias("__first"), F.count(F.lit(1)).alias("__rows"))
        .withColumn("__earlier", F.coalesce(F.sum("__rows").over(before), F.lit(0)))
    )
    placed = attach(blocked, starts.drop("__rows"), [*keys, BLOCK])
    position = F.col("__earlier") + F.col(SEQ) - F.col("__first") + 1
    return placed.withColumn(POSITION, position).drop("__earlier", "__first", SEQ, BLOCK)


def with_frames(
    df: DataFrame,
    add: Callable[[DataFrame, list[str], Order], DataFrame],
    partition_by: str | Sequence[str] | None,
    order_by: Order,
    *,
    before: int = 0,
    after: int = 0,
    group_limit: int = GROUP_ROWS,
) -> DataFrame:
    """Add columns that depend on up to `before` rows back and `after` rows ahead.

    `add` gets rows, the columns of their window partition, and the order in it.
    """
    keys = names(partition_by)
    reach = before + after

    def plain(part: DataFrame) -> DataFrame:
        return add(part, keys, order_by)

    def split(part: DataFrame, rows: int) -> DataFrame:
        size = max(min(group_limit, CHUNK_ROWS), reach)
        home = F.floor((F.col(POSITION) - 1) / size)
        inside = F.pmod(F.col(POSITION) - 1, F.lit(size))
        seen_by = F.array(
            home,
            F.when(inside >= size - before, home + 1),
            F.when((inside < after) & (home > 0), home - 1),
        )
        placed = with_positions(part, keys, order_by, rows, group_limit)
        spread = placed.withColumn(CHUNK, F.explode(F.array_compact(seen_by)))
        measured = add(spread, [*keys, CHUNK], [POSITION])
        return measured.filter(F.col(CHUNK) == home).drop(CHUNK, POSITION)

    return by_group_size(df, keys, group_limit, plain, split)


def with_windows(
    df: DataFrame,
    measures: dict[str, Callable[[WindowSpec], Column]],
    partition_by: str | Sequence[str] | None,
    order_by: Order,
    *,
    before: int = 0,
    after: int = 0,
    group_limit: int = GROUP_ROWS,
) -> DataFrame:
    """Add window measures; each gets the ordered window of its group and returns a column.

    A frame is worked through anew for each row, so this is for narrow ones.
    """

    def add(part: DataFrame, partition: list[str], order: Order) -> DataFrame:
        spec = W.partitionBy(*partition).orderBy(*order)
        return part.withColumns({a: measure(spec) for a, measure in measures.items()})

    return with_frames(
        df, add, partition_by, order_by, before=before, after=after, group_limit=group_limit
    )


def running_total(
    df: DataFrame,
    value: str,
    alias: str,
    partition_by: str | Sequence[str] | None,
    order_by: Order,
    *,
    group_limit: int = GROUP_ROWS,
) -> DataFrame:
    """Running sum. A NULL value gives NULL in its own row and counts as nothing after it."""
    keys = names(partition_by)
    known = F.col(value).isNotNull()

    def so_far(*partition: str, order: Order) -> Column:
        spec = W.partitionBy(*partition).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        return F.sum(value).over(spec)

    def plain(part: DataFrame) -> DataFrame:
        return part.withColumn(alias, F.when(known, so_far(*keys, order=order_by)))

    def split(part: DataFrame, rows: int) -> DataFrame:
        blocked = blocks(part, keys, order_by, rows, group_limit)
        joined = add_earlier(blocked, keys, {"__earlier": F.sum(value)})
        total = so_far(*keys, BLOCK, order=[SEQ]) + F.coalesce(F.col("__earlier"), F.lit(0))
        return joined.withColumn(alias, F.when(known, total)).drop("__earlier", SEQ, BLOCK)

    return by_group_size(df, keys, group_limit, plain, split)


def cumulative_epa(
    df: DataFrame, order_by: Order, partition_by: str | Sequence[str] | None = None, **options
) -> DataFrame:
    return running_total(df, "epa", "cumulative_epa", partition_by, order_by, **options)


# --- rolling measures --------------------------------------------------------------


# What is not a finite number is counted apart from the sums, in fields of one long.
NAN, UP, DOWN = 1, 1 << 20, 1 << 40


def odd_value(value: Column) -> Column:
    infinite = F.lit(float("inf"))
    kind = F.when(F.isnan(value), NAN).when(value == infinite, UP).when(value == -infinite, DOWN).otherwise(0)
    return F.when(value.isNotNull(), kind).otherwise(0).cast("long")


def mean_of(total: Column, count: Column, odd: Column) -> Column:
    """The mean that adding up the values themselves would give."""
    nan, up, down = (F.shiftright(odd, 20 * k) % (1 << 20) > 0 for k in range(3))
    mixed = F.when(nan | (up & down), F.lit(float("nan"))).when(up, F.lit(float("inf")))
    return F.when(odd > 0, mixed.otherwise(F.lit(float("-inf")))).otherwise(F.try_divide(total, count))


def rolling(
    df: DataFrame,
    value: Column,
    alias: str,
    window_size: int,
    partition_by: str | Sequence[str] | None,
    order_by: Order,
    min_values: int = 10,
    **options,
) -> DataFrame:
    """Mean of the last `window_size` rows, NULL with fewer than `min_values` values among them.

    Rows are cut into runs of the window's length. A window is the begin of one run and the end of
    the one before it, and the end is the run's sum less that of its begin: one step per row, whatever
    the window. Sums never reach over more than a run, so no error builds up along a group.
    """
    made = ["__value", "__odd", "__nth", "__run", "__begin", "__rest", "__before"]
    if window_size >= UP:
        raise ValueError(f"a window of {window_size} rows; {UP - 1} at most")

    def add(part: DataFrame, partition: list[str], order: Order) -> DataFrame:
        run = W.partitionBy(*partition, "__run").orderBy("__nth")
        to_here = run.rowsBetween(W.unboundedPreceding, 0)
        whole = run.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        number = value.cast("double")
        nth = F.row_number().over(W.partitionBy(*partition).orderBy(*order))
        rows = part.withColumns({"__odd": odd_value(number), "__value": number, "__nth": nth})
        rows = rows.withColumn("__value", F.when(F.col("__odd") == 0, F.col("__value")))
        rows = rows.withColumn("__run", F.floor((F.col("__nth") - 1) / window_size))

        def figures(frame: WindowSpec) -> list[Column]:
            known = F.col("__value").isNotNull() | (F.col("__odd") > 0)
            sums = F.coalesce(F.sum("__value").over(frame), F.lit(0.0))
            return [sums, F.sum(known.cast("long")).over(frame), F.sum("__odd").over(frame)]

        begin, total = figures(to_here), figures(whole)
        names_ = ("sum", "n", "odd")
        rows = rows.withColumns(
            {
                "__begin": F.struct(*[b.alias(n) for b, n in zip(begin, names_, strict=True)]),
                "__rest": F.struct(*[(t - b).alias(n) for t, b, n in zip(total, begin, names_, strict=True)]),
            }
        )
        # The same order as the runs' own, so nothing is sorted again.
        along = W.partitionBy(*partition).orderBy("__run", "__nth")
        rows = rows.withColumn("__before", F.lag("__rest", window_size).over(along))
        total, count, odd = (F.col("__begin")[n] + F.coalesce(F.col("__before")[n], F.lit(0)) for n in names_)
        return rows.withColumn(alias, F.when(count >= min_values, mean_of(total, count, odd))).drop(*made)

    return with_frames(df, add, partition_by, order_by, before=window_size - 1, **options)


def rolling_epa(df, partition_by, order_by, window_size: int = 50, **options) -> DataFrame:
    alias = f"rolling_epa_{window_size}"
    return rolling(df, F.col("epa"), alias, window_size, partition_by, order_by, **options)


def rolling_success_rate(df, partition_by, order_by, window_size: int = 50, **options) -> DataFrame:
    success = (F.col("epa") > 0).cast("double")
    alias = f"rolling_success_rate_{window_size}"
    return rolling(df, success, alias, window_size, partition_by, order_by, **options)


def rolling_pass_rate(df, partition_by, order_by, window_size: int = 50, **options) -> DataFrame:
    passing = (F.col("play_type") == "pass").cast("double")
    alias = f"rolling_pass_rate_{window_size}"
    return rolling(df, passing, alias, window_size, partition_by, order_by, **options)


def rolling_yards_per_play(df, partition_by, order_by, window_size: int = 50, **options) -> DataFrame:
    alias = f"rolling_ypp_{window_size}"
    return rolling(df, F.col("yards_gained"), alias, window_size, partition_by, order_by, **options)


# --- rolling correlation -----------------------------------------------------------

# Figures of some pairs from which those of their union follow.
PAIRS = ["n", "mean_x", "mean_y", "xx", "yy", "xy", "min_x", "max_x", "min_y", "max_y"]


def pair_figures(x: Column, y: Column, frame: WindowSpec) -> Column:
    """Count, means, sums of squared and mixed deviations, and ranges of the pairs in a frame."""
    n = F.count(x).over(frame)
    figures = [
        n,
        F.avg(x).over(frame),
        F.avg(y).over(frame),
        F.var_pop(x).over(frame) * n,
        F.var_pop(y).over(frame) * n,
        F.covar_pop(x, y).over(frame) * n,
        F.min(x).over(frame),
        F.max(x).over(frame),
        F.min(y).over(frame),
        F.max(y).over(frame),
    ]
    return F.struct(*[f.alias(name) for name, f in zip(PAIRS, figures, strict=True)])


def joint_correlation(a: Column, b: Column, min_pairs: int) -> Column:
    """Correlation over two sets of pairs; NULL for too few pairs or a constant side."""

    def added(name: str) -> Column:
        return F.coalesce(a[name], F.lit(0)) + F.coalesce(b[name], F.lit(0))

    def between(p: str, q: str) -> Column:
        """What the distance of the two means adds to a sum of products."""
        gap = (a[f"mean_{p}"] - b[f"mean_{p}"]) * (a[f"mean_{q}"] - b[f"mean_{q}"])
        return F.coalesce(gap * F.try_divide(a["n"] * b["n"], added("n")), F.lit(0.0))

    def varies(p: str) -> Column:
        return F.least(a[f"min_{p}"], b[f"min_{p}"]) < F.greatest(a[f"max_{p}"], b[f"max_{p}"])

    xx, yy, xy = (added(p + q) + between(p, q) for p, q in ("xx", "yy", "xy"))
    usable = (added("n") >= min_pairs) & varies("x") & varies("y")
    return F.when(usable, F.try_divide(xy, F.sqrt(xx) * F.sqrt(yy)))


def rolling_correlation(
    df: DataFrame,
    x: Column,
    y: Column,
    alias: str,
    window_size: int,
    partition_by: str | Sequence[str] | None,
    order_by: Order,
    min_pairs: int = 20,
    **options,
) -> DataFrame:
    """Correlation over the complete pairs of the last `window_size` rows.

    Rows are cut into runs of the window's length. A window is the end of one run and the
    start of the next, and figures of starts and ends take one step per row, so the cost does
    not grow with the window.
    """
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    made = ["__x", "__y", "__nth", "__run", "__end", "__start", "__before"]

    def add(part: DataFrame, partition: list[str], order: Order) -> DataFrame:
        nth = F.row_number().over(W.partitionBy(*partition).orderBy(*order))
        run = W.partitionBy(*partition, "__run")
        ends = run.orderBy(F.col("__nth").desc()).rowsBetween(W.unboundedPreceding, 0)
        starts = run.orderBy("__nth").rowsBetween(W.unboundedPreceding, 0)
        whole = W.partitionBy(*partition).orderBy("__run", "__nth")
        pairs = F.col("__x"), F.col("__y")
        rows = part.withColumns({"__x": x, "__y": y, "__nth": nth})
        rows = rows.withColumn("__run", F.floor((F.col("__nth") - 1) / window_size))
        rows = rows.withColumn("__end", pair_figures(*pairs, ends))
        # A window that is a whole run has no part in an earlier one.
        earlier = F.when(F.pmod("__nth", F.lit(window_size)) > 0, F.lag("__end", window_size - 1).over(whole))
        rows = rows.withColumns({"__start": pair_figures(*pairs, starts), "__before": earlier})
        result = joint_correlation(F.col("__start"), F.col("__before"), min_pairs)
        return rows.withColumn(alias, result).drop(*made)

    return with_frames(df, add, partition_by, order_by, before=window_size - 1, **options)


def pass_rate_wp_correlation(df, partition_by, order_by, window_size: int = 100, **options) -> DataFrame:
    """Rolling correlation of passing (0/1) with win probability, from 20 pairs on."""
    passing = (F.col("play_type") == "pass").cast("double")
    return rolling_correlation(
        df, passing, F.col("wp"), "pass_wp_correlation", window_size, partition_by, order_by, **options
    )


# --- previous rows -----------------------------------------------------------------


def lag_value(
    df: DataFrame,
    value: str,
    order_by: Order,
    periods: int = 1,
    partition_by: str | Sequence[str] | None = None,
    **options,
) -> DataFrame:
    """The value `periods` rows earlier; negative periods look ahead."""
    return with_windows(
        df,
        {f"{value}_lag{periods}": lambda spec: F.lag(value, periods).over(spec)},
        partition_by,
        order_by,
        before=max(periods, 0),
        after=max(-periods, 0),
        **options,
    )


def delta_from_previous(
    df: DataFrame,
    values: str | Sequence[str],
    order_by: Order,
    partition_by: str | Sequence[str] | None = None,
    **options,
) -> DataFrame:
    """Change from the previous row (not the previous season: gaps are bridged)."""
    deltas = {
        f"{v}_delta": lambda spec, v=v: F.col(v) - F.lag(v, 1).over(spec) for v in names(values)
    }
    return with_windows(df, deltas, partition_by, order_by, before=1, **options)


# --- numbers and ranks -------------------------------------------------------------


def number_rows(
    df: DataFrame,
    alias: str,
    partition_by: str | Sequence[str] | None,
    order_by: Order,
    *,
    group_limit: int = GROUP_ROWS,
) -> DataFrame:
    """Number the rows of each group 1, 2, ... in order."""
    keys = names(partition_by)

    def plain(part: DataFrame) -> DataFrame:
        number = F.row_number().over(W.partitionBy(*keys).orderBy(*order_by))
        return part.withColumn(alias, number.cast("long"))

    def split(part: DataFrame, rows: int) -> DataFrame:
        placed = with_positions(part, keys, order_by, rows, group_limit)
        return placed.withColumn(alias, F.col(POSITION).cast("long")).drop(POSITION)

    return by_group_size(df, keys, group_limit, plain, split)


def rank_within_group(
    df: DataFrame,
    values: str | Sequence[str],
    partition_by: str | Sequence[str],
    ties: Sequence[str],
    descending: bool = True,
    digits: int | None = None,
    *,
    group_limit: int = GROUP_ROWS,
) -> DataFrame:
    """Unique ranks 1, 2, ... in each group, 1 = best; `ties` decide between equal values.

    NULL values come last and stay unranked. With `digits` values are compared rounded: sums
    of doubles differ in the last bits from run to run, and equal ones should stay equal.
    """
    keys = names(partition_by)

    def order(value: str) -> list[str | Column]:
        compared = F.col(value) if digits is None else F.round(value, digits)
        first = compared.desc_nulls_last() if descending else compared.asc_nulls_last()
        return [first, *ties]

    def ranked(value: str, rank: Column) -> Column:
        return F.when(F.col(value).isNotNull(), rank.cast("long"))

    def plain(part: DataFrame) -> DataFrame:
        numbers = {v: F.row_number().over(W.partitionBy(*keys).orderBy(*order(v))) for v in names(values)}
        return part.withColumns({f"{v}_rank": ranked(v, n) for v, n in numbers.items()})

    def split(part: DataFrame, rows: int) -> DataFrame:
        for v in names(values):
            placed = with_positions(part, keys, order(v), rows, group_limit)
            part = placed.withColumn(f"{v}_rank", ranked(v, F.col(POSITION))).drop(POSITION)
        return part

    return by_group_size(df, keys, group_limit, plain, split)
