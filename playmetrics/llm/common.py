"""Byte-level helpers that several operators share. They work on whole Arrow columns at once."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MULTIPLIER = 0x9E3779B97F4A7C15
INVERSE = pow(MULTIPLIER, -1, 1 << 64)
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
NO_ID = (1 << 63) - 1


def trim() -> None:
    """Hand memory that is no longer used back to the system: workers live on between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back is not None:
        give_back(0)


def lean(run: Callable) -> Callable:
    """A function over batches that leaves its worker small when a task ends."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return wrapped


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_out(doc_id: Column) -> Column:
    """Rows whose label is never learned from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def about(df: DataFrame, key: str, rows: int, total: int) -> DataFrame:
    """About `rows` of `total` rows, chosen by a hash of `key`: each task drops the others by itself."""
    if total <= rows:
        return df
    kept = max(1, rows * (1 << 30) // total)
    return df.filter(F.pmod(F.xxhash64(F.lit(7), F.col(key)), F.lit(1 << 30)) < kept)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts one after the other, and where each begins (NULL: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], column.type)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of about `limit` bytes, at least one text each."""
    start, count = 0, len(offsets) - 1
    while start < count:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), count)
        yield start, stop
        start = stop


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < count:
        size = max(count, 1 << 20)
        for k, base in enumerate((MULTIPLIER, INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0][:count], _POWERS[1][:count]


def word_bounds(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, ...]:
    """Begin, end and text number of each maximal run of bytes marked `inside`, text by text."""
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    after = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = inside[:-1]
    after[-1:] = False
    after[:-1] = inside[1:]
    begins = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return begins, ends, np.searchsorted(offsets, begins, side="right") - 1


def word_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit value per word, the same wherever the word stands."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    return mix((total[ends] - total[begins]) * down[begins])


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: int, rows: int = 4096) -> Iterator[pa.Table]:
    """Tables of whole groups from a stream sorted by its first `keys` columns; several small
    groups come together, about `rows` rows at a time."""
    kept: list[pa.RecordBatch] = []
    count = 0

    def boundary(table: pa.Table) -> int:
        """Row at which the last group begins."""
        at = 0
        for k in range(keys):
            values = np.asarray(table.column(k).combine_chunks().fill_null(-1))
            same = values == values[-1]
            at = max(at, int(len(same) - np.argmin(same[::-1])) if not same.all() else 0)
        return at

    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        table = pa.Table.from_batches(kept)
        at = boundary(table)
        if at:
            yield table.slice(0, at)
            table = table.slice(at)
        kept, count = table.to_batches(), table.num_rows
        rows = max(rows, 2 * count) if not at else rows
    if kept:
        yield pa.Table.from_batches(kept)
