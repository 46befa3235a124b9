"""Choices that depend on how large something really is."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A side of a join is broadcast up to this measured size. Beyond it the join shuffles, and
# AQE splits skewed keys.
BROADCAST_BYTES = 64 * 1024 * 1024

# A window partition may hold this many rows in one task. Beyond it the ordered operators
# split the group into blocks.
GROUP_ROWS = 2_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, from `spark.checkpoint.dir`.

    Local mode gets a temporary folder if it is unset. On a cluster there is no safe guess.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if folder is None:
        folder = context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="playmetrics-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, under the application's id: all that a job left
    there can be removed at once."""
    folder = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}"
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder once and read them from there after that.

    For frames that are used more than once, and for values such as partition numbers that
    must not change when a lost executor's work is done again.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def settle_table(df: DataFrame, name: str) -> DataFrame:
    """The same for frames that may be as large as the input: a Parquet table, which is
    compressed and read by column."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def value_bytes(value: Column, kind: T.DataType) -> Column:
    """About how much memory a value takes: 16 bytes, and what texts, binaries, arrays, maps and
    structs hold. Values of unknown kinds count by their text."""
    if isinstance(kind, T.StringType | T.BinaryType):
        held = F.octet_length(value)
    elif isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, FIXED):
            held = F.size(value) * 16
        else:
            held = F.aggregate(value, F.lit(0).cast("long"), lambda n, x: n + value_bytes(x, kind.elementType))
    elif isinstance(kind, T.MapType):
        keys, values = T.ArrayType(kind.keyType), T.ArrayType(kind.valueType)
        held = value_bytes(F.map_keys(value), keys) + value_bytes(F.map_values(value), values)
    elif isinstance(kind, T.StructType):
        held = sum((value_bytes(value[f.name], f.dataType) for f in kind), F.lit(0).cast("long"))
    elif isinstance(kind, FIXED):
        held = F.lit(0)
    else:
        held = F.octet_length(F.to_json(F.struct(value)))
    return F.coalesce(held.cast("long"), F.lit(0).cast("long")) + 16


FIXED = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.NullType)


def small_enough(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the rows of a settled frame fit the limit."""
    sizes = [value_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema]
    size = F.sum(sum(sizes, F.lit(0).cast("long")))
    return (df.agg(size.alias("size")).first()["size"] or 0) <= limit


def same_keys(left: DataFrame, right: DataFrame, pairs: dict[str, str]) -> Column:
    """Null-safe equality of the key pairs: NULL is a group like any other."""
    condition = F.lit(True)
    for a, b in pairs.items():
        condition = condition & left[a].eqNullSafe(right[b])
    return condition


def attach(
    df: DataFrame,
    side: DataFrame,
    on: Sequence[str] | dict[str, str],
    *,
    settled: bool = False,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Left-join a frame that has one row per key onto a much larger one.

    The side is written as a table and measured first. Up to `broadcast_bytes` it is broadcast and the
    large frame does not move; beyond that both are shuffled on the key. `on` maps columns of
    `df` to columns of `side`; the key columns of the side are dropped.
    """
    pairs = dict(on) if isinstance(on, dict) else {c: c for c in on}
    side = side if settled else settle_table(side, "side")
    renamed = {b: f"__key_{b}" for b in pairs.values()}
    other = side.withColumnsRenamed(renamed)
    if small_enough(side, broadcast_bytes):
        other = F.broadcast(other)
    condition = same_keys(df, other, {a: renamed[b] for a, b in pairs.items()})
    return df.join(other, condition, "left").drop(*renamed.values())


def large_groups(df: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """Keys and `__size` of the groups with more than `limit` rows, from one count over `df`."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__size"))
    return settle(sizes.filter(F.col("__size") > limit))
