"""Similarity join of vectors by epsilon grid order.

Vectors are compared within their label and length. Two unit vectors of cosine t are sqrt(2 - 2t) apart;
that distance is epsilon. Vectors are sorted by the cells of a grid of that width on a few leading
principal directions, label by label, and the sequence is cut into blocks. A block has a box: the
least and largest projection on each direction and on what the directions leave over. The distance
of two boxes never exceeds that of two vectors in them, whatever the directions are, so blocks farther
apart than epsilon are skipped for certain. The join is recursive: it starts from one interval per label, and
of each pair of intervals that may hold a link the pairs of their eighths follow, down to blocks.

Copies of a vector are one entry with a count. Block pairs give link counts and a spanning forest instead of
pairs, so a group in which all vectors are linked costs a few rows per vector and tile.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from playmetrics.llm.common import about, lean, trim
from playmetrics.llm.components import components
from playmetrics.operators.sizing import attach, settle_table

DIRECTIONS = 12
# Directions are fitted on at most this many vectors, and this many bytes, of each of the commonest lengths;
# the other lengths use their first coordinates. That only changes which blocks are skipped.
SAMPLE_ROWS, SAMPLE_BYTES, FITTED_LENGTHS = 20_000, 1 << 24, 4
BLOCK_ROWS, BLOCK_BYTES = 256, 1 << 20
FAN = 8
# Room for rounding: cosines this close to the threshold are worked out again, exactly rounded.
SLACK = 1e-9


def usable(vector: Column) -> Column:
    """Not NULL, not empty, all components finite, not zero."""
    infinite = float("inf")
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; the largest component is taken out first, so no square is lost."""
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def stacked(column: pa.Array, width: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def as_bytes(df: DataFrame, kind: str) -> DataFrame:
    """`vector`, an array, as the bytes of its components."""
    schema = pa.schema([("row_id", pa.int64()), ("label", pa.string()), ("width", pa.int32()), ("vector", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector")
            widths = np.diff(np.asarray(vectors.offsets))
            raw = np.asarray(vectors.flatten()).astype(kind) + 0.0  # no negative zero: equal vectors are equal bytes
            ends, data, size = np.cumsum(widths), raw.tobytes(), raw.itemsize
            out = [data[int(e - w) * size : int(e) * size] for e, w in zip(ends, widths, strict=True)]
            columns = [batch.column("row_id"), batch.column("label"), pa.array(widths, pa.int32()), pa.array(out, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return df.mapInArrow(lean(run), "row_id long, label string, width int, vector binary")


def fit_directions(classes: DataFrame, kind: str) -> dict[int, np.ndarray]:
    """Leading principal directions of the unit vectors of the commonest lengths, from a bounded sample."""
    lengths = classes.groupBy("width").count().orderBy(F.desc("count"), "width").limit(FITTED_LENGTHS).collect()
    out = {}
    for width, total in lengths:
        rows = max(2, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * width)))
        sample = about(classes.filter(F.col("width") == width), "key", rows, total).select("vector").limit(2 * rows).toArrow()
        if sample.num_rows < 2 or width * width * 8 > SAMPLE_BYTES:
            continue
        units = unit(stacked(sample.column("vector").combine_chunks(), width, kind))
        _, axes = np.linalg.eigh(np.cov(units.T).reshape(width, width))
        out[width] = np.ascontiguousarray(axes[:, ::-1][:, :DIRECTIONS])
    return out


def projections(units: np.ndarray, directions: dict[int, np.ndarray]) -> np.ndarray:
    """Projections on the directions (zeros if there are fewer), then the length of the rest."""
    width = units.shape[1]
    axes = directions.get(width)
    first = units[:, :DIRECTIONS] if axes is None else units @ axes
    out = np.zeros((len(units), DIRECTIONS + 1))
    out[:, : first.shape[1]] = first
    out[:, -1] = np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", first, first)))
    return out


def placed(classes: DataFrame, directions: dict[int, np.ndarray], epsilon: float, kind: str) -> DataFrame:
    """The distinct vectors with their grid cells and projections."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = np.asarray(batch.column("width"))
            found = np.empty((batch.num_rows, DIRECTIONS + 1))
            for width in np.unique(widths):
                mine = np.flatnonzero(widths == width)
                rows = stacked(batch.column("vector").take(pa.array(mine)), int(width), kind)
                found[mine] = projections(unit(rows), directions)
            cells = np.floor(found[:, :-1] / epsilon).astype(np.int32)
            lists = [
                pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(t))
                for x, t in ((cells, pa.int32()), (found, pa.float64()))
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists], [*batch.schema.names, "cells", "place"])

    kept = "key string, label string, width int, vector binary, copies long, first_id long"
    given = classes.select("key", "label", "width", "vector", "copies", "first_id")
    return given.mapInArrow(lean(run), f"{kept}, cells array<int>, place array<double>")


def blocks(classes: DataFrame, kind: str) -> DataFrame:
    """Consecutive vectors of a label and length in grid order, a row per block. The digest breaks ties, so
    a crowded cell is dealt over tasks like everything else."""
    order = ["label", "width", "cells", "key"]
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = classes.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    size = np.dtype(kind).itemsize
    schema = pa.schema([
        ("label", pa.string()), ("width", pa.int32()), ("seq", pa.int64()), ("vectors", pa.binary()), ("keys", pa.list_(pa.string())),
        ("copies", pa.list_(pa.int64())), ("first_ids", pa.list_(pa.int64())), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())),
    ])

    def one(rows: pa.Table, seq: int) -> pa.RecordBatch:
        place = np.array(rows.column("place").to_pylist())
        row = {
            "label": rows.column("label")[0].as_py(), "width": rows.column("width")[0].as_py(), "seq": seq,
            "vectors": b"".join(rows.column("vector").to_pylist()), "keys": rows.column("key").to_pylist(),
            "copies": rows.column("copies").to_pylist(), "first_ids": rows.column("first_id").to_pylist(),
            "low": place.min(axis=0).tolist(), "high": place.max(axis=0).tolist(),
        }
        return pa.RecordBatch.from_pylist([row], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, kept = 0, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if kept is None else pa.concat_tables([kept, table])
            # A block ends where the label or length changes, and when it is full.
            labels, widths = table.column("label").to_pylist(), table.column("width").to_pylist()
            start = 0
            for k in range(1, table.num_rows):
                most = max(16, min(BLOCK_ROWS, BLOCK_BYTES // (size * widths[start])))
                if k - start >= most or labels[k] != labels[start] or widths[k] != widths[start]:
                    yield one(table.slice(start, k - start), seq)
                    seq, start = seq + 1, k
            kept = table.slice(start)
        if kept is not None and kept.num_rows:
            yield one(kept, seq)

    row = (
        "label string, width int, seq long, vectors binary, keys array<string>, copies array<long>, "
        "first_ids array<long>, low array<double>, high array<double>"
    )
    # Partitions are in order, so (partition, seq) is the order of the blocks.
    made = ordered.mapInArrow(lean(run), row).withColumn("part", F.spark_partition_id())
    return settle_table(made, "blocks")


def gap(a: str, b: str, epsilon: float) -> Column:
    """Whether two boxes are at most epsilon apart."""
    sides = F.zip_with(f"{a}_low", f"{b}_high", lambda x, y: F.greatest(x - y, F.lit(0.0)))
    others = F.zip_with(f"{b}_low", f"{a}_high", lambda x, y: F.greatest(x - y, F.lit(0.0)))
    squares = F.zip_with(sides, others, lambda x, y: x * x + y * y)
    return F.aggregate(squares, F.lit(0.0), lambda s, x: s + x) <= epsilon * epsilon + SLACK


def near_pairs(blocks_: DataFrame, epsilon: float) -> DataFrame:
    """Pairs (a <= b) of block numbers of one sequence that may hold a link, by recursion over intervals."""
    nodes = blocks_.select("seq_id", "nth", "low", "high")
    deepest = nodes.agg(F.max("nth").alias("n")).first()["n"]
    if deepest is None:
        return nodes.select("seq_id", F.col("nth").alias("a"), F.col("nth").alias("b"))
    levels = [nodes]
    while deepest > 0:
        deepest //= FAN
        # Boxes of boxes: least and largest value per direction.
        low = F.array(*[F.min(F.col("low")[i]) for i in range(DIRECTIONS + 1)])
        high = F.array(*[F.max(F.col("high")[i]) for i in range(DIRECTIONS + 1)])
        grouped = levels[-1].groupBy("seq_id", F.expr(f"nth div {FAN}").alias("nth"))
        levels.append(settle_table(grouped.agg(low.alias("low"), high.alias("high")), "intervals"))
    pairs = levels[-1].select("seq_id", F.col("nth").alias("a"), F.col("nth").alias("b"))
    for level in levels[-2::-1]:
        sides = [
            level.select(
                "seq_id", F.expr(f"nth div {FAN}").alias(f"{c}"), F.col("nth").alias(f"{c}_nth"),
                F.col("low").alias(f"{c}_low"), F.col("high").alias(f"{c}_high"),
            )
            for c in "ab"
        ]
        parts = reduce(lambda left, side: left.join(side[1], ["seq_id", side[0]]), zip("ab", sides, strict=True), pairs)
        near = parts.filter((F.col("a_nth") <= F.col("b_nth")) & gap("a", "b", epsilon))
        pairs = settle_table(near.select("seq_id", F.col("a_nth").alias("a"), F.col("b_nth").alias("b")), "near")
    return pairs


def cosine(x: np.ndarray, y: np.ndarray) -> float:
    """Each sum rounded once."""
    x, y = x.astype(np.float64).tolist(), y.astype(np.float64).tolist()
    dot = math.fsum(a * b for a, b in zip(x, y, strict=True))
    return dot / (math.sqrt(math.fsum(a * a for a in x)) * math.sqrt(math.fsum(b * b for b in y)))


def linked(a: np.ndarray, b: np.ndarray, ua: np.ndarray, ub: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of a and b have a cosine of the threshold or more."""
    found = ua @ ub.T
    sure = found >= threshold + SLACK
    for i, j in np.argwhere((found >= threshold - SLACK) & ~sure).tolist():
        sure[i, j] = cosine(a[i], b[j]) >= threshold
    return sure


def merge(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the trees of linked rows; a tree's root is its smallest row."""
    while True:
        a, b = root[i], root[j]
        differ = a != b
        if not differ.any():
            return
        np.minimum.at(root, np.maximum(a, b)[differ], np.minimum(a, b)[differ])
        while not np.array_equal(root, again := root[root]):
            root[:] = again


def compare(needed: pa.Table, pairs: pa.Table, threshold: float, kind: str) -> list[tuple[int, int, int]]:
    """For the block pairs of a tile: (entry, copies of the entries linked with it here, first entry of its tree here)."""
    rows = {r["number"]: r for r in needed.to_pylist()}
    raw, units, copies, starts, ids = {}, {}, {}, {}, []
    total = 0
    for number, r in rows.items():
        raw[number] = np.frombuffer(r["vectors"], kind).reshape(-1, r["width"])
        units[number], copies[number] = unit(raw[number]), np.array(r["copies"])
        starts[number] = total
        total += len(copies[number])
        ids.append(r["entry"] + np.arange(len(copies[number])))
    counts, root = np.zeros(total, np.int64), np.arange(total)
    for a, b in zip(pairs.column("a_number").to_pylist(), pairs.column("b_number").to_pylist(), strict=True):
        near = linked(raw[a], raw[b], units[a], units[b], threshold)
        if a == b:
            np.fill_diagonal(near, False)
        i, j = np.nonzero(near)
        if not len(i):
            continue
        counts[starts[a] : starts[a] + len(near)] += near @ copies[b]
        if a != b:
            counts[starts[b] : starts[b] + near.shape[1]] += copies[a] @ near
        merge(root, i + starts[a], j + starts[b])
    entry = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    some = np.flatnonzero(counts)
    return list(zip(entry[some].tolist(), counts[some].tolist(), entry[root[some]].tolist(), strict=True))


def links(blocks_: DataFrame, pairs: DataFrame, threshold: float, kind: str) -> DataFrame:
    """(entry, n, tree) per tile; a tile takes the pairs of two runs of eight blocks, and each block is sent
    once to every tile that needs it."""
    named = [
        blocks_.select("seq_id", F.col("nth").alias(c), F.col("number").alias(f"{c}_number")) for c in "ab"
    ]
    tiled = reduce(lambda left, side: left.join(side[1], ["seq_id", side[0]]), zip("ab", named, strict=True), pairs)
    tiled = settle_table(
        tiled.select("seq_id", F.expr(f"a div {FAN}").alias("i"), F.expr(f"b div {FAN}").alias("j"), "a_number", "b_number"), "tiles"
    )
    tile = ["seq_id", "i", "j"]
    of = [f"of_{c}" for c in tile]
    wanted = tiled.select(*[F.col(c).alias(f"of_{c}") for c in tile], F.explode(F.array("a_number", "b_number")).alias("number")).distinct()
    sent = wanted.join(blocks_.select("number", "entry", "width", "vectors", "copies"), "number")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = compare(left, right, threshold, kind)
        columns = [pa.array([r[k] for r in found], pa.int64()) for k in range(3)]
        trim()
        return pa.table(columns, ["entry", "n", "tree"])

    return sent.groupBy(*of).cogroup(tiled.groupBy(*tile)).applyInArrow(run, "entry long, n long, tree long")


def join(
    vectors: DataFrame, threshold: float = 0.98, *, row_id: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> DataFrame:
    """Link the vectors of one label whose cosine, in double precision, is `threshold` or more.

    Returns one row per input row: vec_id, n_links (other rows linked directly), component_id (the smallest
    vec_id reachable by links, its own included), kept (vec_id = component_id). Exact: the grid only
    decides which blocks need not be compared.

    Rows whose label is NULL, and vectors that are NULL, empty, zero or hold NULL or non-finite components, link with
    nothing and are their own component; so do vectors of different lengths among each other. Copies
    are linked with each other. Repeated rows are rows of their own that link with each other, under
    one vec_id; a NULL vec_id takes part, and its component has the smallest known id, if any. An empty
    table gives no rows. Other columns take no part.
    """
    element = vectors.schema[vector].dataType.elementType.typeName()
    kind = "<f4" if element == "float" else "<f8"
    numbers = F.col(vector) if kind == "<f4" else F.col(vector).cast("array<double>")
    named = vectors.select(
        F.col(row_id).cast("long").alias("row_id"), F.col(label).cast("string").alias("label"), numbers.alias("vector")
    )
    part = F.col("label").isNotNull() & usable(F.col("vector"))
    raw = as_bytes(named.filter(part), kind).withColumn("key", F.sha2(F.concat("label", F.lit("\0"), F.hex("vector")), 256))
    # One entry per distinct vector of a label; copies are counted in each task before the shuffle.
    entries = raw.groupBy("key").agg(
        F.first("label").alias("label"), F.first("width").alias("width"), F.first("vector").alias("vector"),
        F.count(F.lit(1)).alias("copies"), F.min("row_id").alias("first_id"),
    )
    entries = settle_table(entries, "entries")
    epsilon = math.sqrt(max(0.0, 2 - 2 * threshold) + SLACK)
    made = blocks(placed(entries, fit_directions(entries, kind), epsilon, kind), kind)

    along = W.partitionBy("label", "width").orderBy("part", "seq")
    heads = made.select(
        "label", "width", "part", "seq", "low", "high", (F.row_number().over(along) - 1).cast("long").alias("nth"),
        F.xxhash64("label", "width").alias("seq_id"),
    )
    number = F.shiftleft(F.col("part").cast("long"), 40) + F.col("seq")
    # A block has at most 256 rows, so its number and a place in it name an entry.
    numbered = made.select("part", "seq", "width", "vectors", "copies", "keys", "first_ids", number.alias("number")).withColumn(
        "entry", F.col("number") * BLOCK_ROWS
    )
    heads = settle_table(heads, "heads")
    whole = numbered.join(heads.select("part", "seq", "seq_id", "nth"), ["part", "seq"])
    found = settle_table(links(whole, near_pairs(heads, epsilon), threshold, kind), "links")

    classes = numbered.select(
        F.posexplode(F.arrays_zip("keys", "copies", "first_ids")).alias("at", "x"), "entry"
    ).select(
        (F.col("entry") + F.col("at")).alias("entry"), F.col("x.keys").alias("key"),
        F.col("x.copies").alias("copies"), F.col("x.first_ids").alias("first_id"),
    )
    trees = components(found.select(F.col("entry").alias("u"), F.col("tree").alias("v")))
    counts = found.groupBy("entry").agg(F.sum("n").alias("n"))
    joined = classes.join(counts, "entry", "left").join(trees.withColumnRenamed("node", "entry"), "entry", "left")
    figures = settle_table(
        joined.select(
            "key", "first_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
            F.coalesce("component", "entry").alias("component"),
        ), "figures",
    )
    # A component's smallest id: one row per component, joined back; a large component is a skewed key that AQE splits.
    least = figures.groupBy("component").agg(F.min("first_id").alias("component_id"))
    figures = attach(figures, least, ["component"]).select("key", "n_links", "component_id")
    rows = attach(raw.select("row_id", "key"), figures, ["key"])
    alone = named.filter(~part).select("row_id", F.lit(0).cast("long").alias("n_links"), F.col("row_id").alias("component_id"))
    every = rows.select("row_id", "n_links", "component_id").unionByName(alone)
    return every.select(
        F.col("row_id").alias(row_id), "n_links", "component_id",
        F.coalesce(F.col("row_id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )
