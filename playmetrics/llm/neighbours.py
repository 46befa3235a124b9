"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are hashed by floor((a.x + b) / w) for several a, which makes a bucket of a table; a query
visits its own bucket and then perturbed ones in the order of their estimated success, which follows
from how near its projections are to the cell borders. Candidates of all tables are merged and
ranked by exact inner products. For largest inner products, vectors get one more component that
makes all of them as long as the longest (a query has 0 there): the nearest is then the largest.
Vectors lie on shelves: one per number of components and per power of two of the length, seen from the
longest. A shelf has its own longest vector, its own hash functions, and numbers of functions,
tables and probes chosen for it; a query visits all shelves of its number of components.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from playmetrics.llm.common import lean, mix, sorted_groups
from playmetrics.operators.sizing import attach, settle_table


class Settings(NamedTuple):
    """For about `trials` queries the exact nearest on each shelf are found first. Of all numbers of
    functions, tables (at most `tables`) and probes (at most `probes`) that find `recall` of them, a shelf
    gets those of the least cost: rows compared, as estimated from about `sample` rows of the shelf, and
    `copy` comparisons for each copy of a vector that is sent to a bucket."""

    tables: int = 10
    probes: int = 64  # per table
    width: float = 2.0  # of a cell, for vectors of length 1
    recall: float = 0.95
    trials: int = 48
    sample: int = 2000
    copy: int = 100
    few: int = 64  # a shelf of so few vectors is one bucket
    shelves: int = 20  # powers of two below the longest; still shorter vectors share the last shelf
    block: int = 4096  # a bucket of more vectors is searched in parts
    queries: int = 8192  # and one that more queries visit in blocks of them
    turn: int = 256  # queries compared with a part at once
    seed: int = 5


class Plan(NamedTuple):
    """How a shelf is hashed. No functions: it is one bucket."""

    longest: float = 1.0
    functions: int = 0
    tables: int = 1
    probes: int = 1
    shelf: int = 0


def family(dim: int, plan: Plan, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Projections (dim + 1, tables * functions) and offsets, the same in every task. Those of fewer
    tables are the first ones of more."""
    size = plan.tables * plan.functions
    slopes, offsets = (np.random.default_rng([settings.seed, dim, plan.functions, k]) for k in range(2))
    return slopes.normal(size=(size, dim + 1)).T, offsets.uniform(0, settings.width, size)


def keys_of(cells: np.ndarray, table: int, dim: int, shelf: int) -> np.ndarray:
    """One 64-bit key per row of cells, table, dimension and shelf included."""
    key = mix(np.full(len(cells), (dim << 20) + (shelf << 10) + table, np.uint64))
    for c in cells.T:
        key = mix(key ^ c.astype(np.int64).view(np.uint64))
    return key.view(np.int64)


def lengthened(x: np.ndarray, longest: float) -> np.ndarray:
    x = x / longest
    return np.column_stack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1)))])


def perturbations(places: np.ndarray, probes: int) -> list[list[tuple[int, int]]]:
    """The `probes` sets of (function, step) of smallest summed squared distance to the borders.
    `places`: where in its cell, from 0 to 1, a query lies for each function. The first set is empty."""
    m = len(places)
    moves = sorted([(p * p, k, -1) for k, p in enumerate(places)] + [((1 - p) ** 2, k, 1) for k, p in enumerate(places)])
    out: list[list[tuple[int, int]]] = [[]]
    heap: list[tuple[float, tuple[int, ...]]] = [(moves[0][0], (0,))]
    while heap and len(out) < probes:
        cost, chosen = heapq.heappop(heap)
        last = chosen[-1]
        if len({moves[i][1] for i in chosen}) == len(chosen):
            out.append([moves[i][1:] for i in chosen])
        if last + 1 < 2 * m:  # replace the last move by the next, or add the next
            step = moves[last + 1][0]
            heapq.heappush(heap, (cost - moves[last][0] + step, (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (cost + step, (*chosen, last + 1)))
    return out


def index_keys(x: np.ndarray, plan: Plan, settings: Settings) -> np.ndarray:
    """(rows, tables) of bucket keys."""
    a, b = family(x.shape[1], plan, settings)
    cells = np.floor((lengthened(x, plan.longest) @ a + b) / settings.width).reshape(len(x), plan.tables, plan.functions)
    return np.column_stack([keys_of(cells[:, t], t, x.shape[1], plan.shelf) for t in range(plan.tables)])


def probe_keys(q: np.ndarray, plan: Plan, settings: Settings) -> np.ndarray:
    """(rows, tables, probes) of bucket keys in the order of the probes; where there are fewer sets
    than probes, the rest repeats the first."""
    a, b = family(q.shape[1], plan, settings)
    unit = q / np.abs(q).max(axis=1)[:, None]
    unit = unit / np.linalg.norm(unit, axis=1)[:, None]
    at = (np.column_stack([unit, np.zeros(len(q))]) @ a + b) / settings.width
    cells = np.floor(at)
    out = np.empty((len(q), plan.tables, plan.probes), np.int64)
    for i in range(len(q)):
        for t in range(plan.tables):
            own = slice(t * plan.functions, (t + 1) * plan.functions)
            visited = np.repeat(cells[i, own][None], plan.probes, axis=0)
            sets = perturbations(at[i, own] - cells[i, own], plan.probes) if plan.functions else []
            for k, chosen in enumerate(sets):
                for f, step in chosen:
                    visited[k, f] += step
            out[i, t] = keys_of(visited, t, q.shape[1], plan.shelf)
    return out


def first_probe(index: np.ndarray, probes: np.ndarray) -> np.ndarray:
    """(rows, tables): the number of the probe of one query that meets a row in a table; the number of
    probes where none does. `index` is (rows, tables), `probes` (tables, probes)."""
    out = np.empty(index.shape, np.int64)
    for t in range(index.shape[1]):
        keys, rank = np.unique(probes[t], return_index=True)
        at = np.minimum(np.searchsorted(keys, index[:, t]), len(keys) - 1)
        out[:, t] = np.where(keys[at] == index[:, t], rank[at], probes.shape[1])
    return out


FUNCTIONS = (16, 12, 10, 8, 6, 5, 4, 3, 2, 1)
TABLES = (2, 3, 4, 6, 8, 10, 12, 16, 24)
PROBES = (1, 2, 4, 8, 16, 24, 32, 48, 64, 96, 128)


def tuned(
    sample: np.ndarray, asked: np.ndarray, nearest: list[np.ndarray], rows: int, queries: int, plan: Plan, settings: Settings,
) -> tuple[Plan, float, float]:
    """The cheapest plan that finds `settings.recall` of the nearest rows of each query asked, that
    recall, and the rows compared per query as a share of the shelf (a row counts once per table in
    which it is met). One bucket if no plan reaches the recall."""
    nearest = [x for x in nearest if len(x)]
    if not len(sample) or not nearest:
        return plan, 1.0, 1.0
    tables = [t for t in TABLES if t < settings.tables] + [settings.tables]
    probes = [p for p in PROBES if p < settings.probes] + [settings.probes]
    best, cost = (plan, 1.0, 1.0), np.inf
    for functions in FUNCTIONS:
        whole = plan._replace(functions=functions, tables=settings.tables, probes=settings.probes)
        index = index_keys(sample, whole, settings)
        visits = probe_keys(asked, whole, settings)
        found = np.concatenate([first_probe(index_keys(x, whole, settings), v) for x, v in zip(nearest, visits, strict=False)])
        met = np.concatenate([first_probe(index, v) for v in visits])
        for t in tables:
            for p in probes:
                recall = (found[:, :t] < p).any(1).mean()
                if recall < settings.recall:
                    continue
                share = (met[:, :t] < p).sum() / len(met)
                copies = t * p + t * rows / max(queries, 1)
                if share * rows + settings.copy * copies < cost:
                    cost = share * rows + settings.copy * copies
                    best = (whole._replace(tables=t, probes=p), float(recall), float(share))
                break  # more probes only cost more
    return best


def usable(vector: Column) -> Column:
    """Not NULL, not empty, all components finite and some not 0."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a list column whose lists are equally long."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def by_length(column: pa.Array) -> Iterator[np.ndarray]:
    """Row numbers of vectors of one length each: only those can be compared."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        yield np.flatnonzero(sizes == size)


def norm_of(vector: Column) -> Column:
    """The length of a usable vector. Where its squares overflow or vanish, its largest component."""
    squares = F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x)
    most = F.aggregate(vector, F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    return F.when((squares > 1e-290) & (squares < float("inf")), F.sqrt(squares)).otherwise(most)


def hashed(rows: DataFrame, settings: Settings, probing: bool) -> DataFrame:
    """(cid, v, shelf, plan) becomes (cid, v, keys): the different keys of all tables, or of all probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plans = batch.select(list(Plan._fields)).to_pylist()
            alike: dict[tuple, list[int]] = {}
            for k, size in enumerate(batch.column(1).value_lengths().to_pylist()):
                alike.setdefault((size, Plan(**plans[k])), []).append(k)
            for (_, plan), where in alike.items():
                for at in range(0, len(where), 256):
                    part = batch.take(pa.array(where[at : at + 256]))
                    x = matrix(part.column(1))
                    keys = probe_keys(x, plan, settings) if probing else index_keys(x, plan, settings)
                    keys = keys.reshape(len(x), -1)
                    owner = np.repeat(np.arange(len(x)), keys.shape[1])
                    pairs = np.unique(np.column_stack([owner, keys.ravel()]), axis=0)
                    cuts = np.searchsorted(pairs[:, 0], np.arange(len(x) + 1)).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(pairs[:, 1]))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], ["cid", "v", "keys"])

    return rows.select("cid", "v", *Plan._fields).mapInArrow(lean(run), "cid long, v array<double>, keys array<long>")


def nearest_on_shelves(rows: DataFrame, trials: list, k: int) -> DataFrame:
    """(d, shelf, q, cid): the k nearest rows on each shelf of each trial (cid, d, v), itself not among
    them. Every task keeps the best of its rows, ids and scores only."""
    asked: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for d in {r["d"] for r in trials}:
        same = [r for r in trials if r["d"] == d]
        asked[d] = np.array([r["cid"] for r in same]), np.array([r["v"] for r in same])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple, list] = {}
        for batch in batches:
            shelf, cid = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for where in by_length(batch.column(2)):
                d = len(batch.column(2)[int(where[0])])
                if d not in asked:
                    continue
                x, names, q = matrix(batch.column(2).take(pa.array(where))), *asked[d]
                for s in np.unique(shelf[where]):
                    on = np.flatnonzero(shelf[where] == s)
                    for name, got in zip(names, nearest_in(x[on], cid[where][on], q, k + 1), strict=True):
                        kept = best.setdefault((d, int(s), int(name)), [np.zeros(0, np.int64), np.zeros(0)])
                        ids, scores = np.concatenate([kept[0], got[0]]), np.concatenate([kept[1], got[1]])
                        order = np.lexsort((ids, -scores))
                        order = order[ids[order] != name][:k]
                        kept[:] = ids[order], scores[order]
        rows = [(*key, int(c), float(x)) for key, got in best.items() for c, x in zip(*got, strict=True)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["d", "shelf", "q", "cid", "score"])

    found = rows.select("shelf", "cid", "v").mapInArrow(lean(run), "d long, shelf long, q long, cid long, score double")
    order = Window.partitionBy("d", "shelf", "q").orderBy(F.desc("score"), "cid")
    return found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).select("d", "shelf", "q", "cid")


def shelved(classes: DataFrame, settings: Settings) -> DataFrame:
    """(cid, v, d, norm, shelf) of the classes (cid, v, norm)."""
    rows = classes.select("cid", "v", F.size("v").alias("d"), "norm")
    rows = attach(rows, rows.groupBy("d").agg(F.max("norm").alias("top")), ["d"])
    halvings = F.floor(F.log2("top") - F.log2("norm"))
    shelf = F.greatest(F.lit(0), F.least(F.lit(settings.shelves), halvings))
    return rows.select("cid", "v", "d", "norm", shelf.cast("int").alias("shelf"))


def planned(rows: DataFrame, asked: DataFrame, k: int, settings: Settings) -> DataFrame:
    """(d, shelf, rows, longest, functions, tables, probes, recall, share), one row per shelf of a number of
    components that some query has. `rows` have cid, v, d, norm and shelf, `asked` cid, v and d.

    A shelf's sample, trials and nearest rows meet in one task: about `sample` + `trials` * (k + 1) vectors.
    The trials alone, about `trials` vectors per number of components, pass through the driver.
    """
    queries = asked.groupBy("d").agg(F.count(F.lit(1)).alias("queries"))
    shelves = rows.groupBy("d", "shelf").agg(F.count(F.lit(1)).alias("rows"), F.max("norm").alias("longest"))
    shelves = settle_table(shelves.join(queries, "d"), "shelves")
    many = shelves.filter(F.col("rows") > settings.few)
    some = many.groupBy("d").agg(F.max("queries").alias("queries"))
    trials = attach(asked, some, ["d"]).filter(drawn("cid", settings.trials, F.col("queries"), 11)).select("d", "cid", "v")
    trials = settle_table(trials, "trials")
    near = nearest_on_shelves(rows, trials.collect(), k)
    near = near.join(rows.select("cid", "v"), "cid").select("d", "shelf", "q", "v", F.lit(2).alias("kind"))
    sample = attach(rows.select("d", "shelf", "cid", "v"), many, ["d", "shelf"], settled=True)
    sample = sample.filter(drawn("cid", settings.sample, F.col("rows"), 13))
    sample = sample.select("d", "shelf", F.lit(0).cast("long").alias("q"), "v", F.lit(0).alias("kind"))
    tried = many.select("d", "shelf").join(trials.withColumnRenamed("cid", "q"), "d")
    given = sample.unionByName(tried.select("d", "shelf", "q", "v", F.lit(1).alias("kind"))).unionByName(near)
    given = given.join(many.select("d", "shelf", "rows", "queries", "longest"), ["d", "shelf"])

    def choose(key: tuple, table: pd.DataFrame) -> pd.DataFrame:
        def part(kind: int) -> pd.DataFrame:
            return table[table["kind"] == kind]

        one, tried = table.iloc[0], part(1)
        plan = Plan(longest=float(one["longest"]), shelf=int(key[1]))
        near = {q: np.array(g["v"].tolist()) for q, g in part(2).groupby("q")}
        asked = tried[tried["q"].isin(list(near))]
        got = tuned(
            np.array(part(0)["v"].tolist()), np.array(asked["v"].tolist()), [near[q] for q in asked["q"]],
            int(one["rows"]), int(one["queries"]), plan, settings,
        )
        return pd.DataFrame([(*key, *got[0][1:4], *got[1:])], columns=["d", "shelf", "functions", "tables", "probes", "recall", "share"])

    plans = given.groupBy("d", "shelf").applyInPandas(
        choose, "d int, shelf int, functions int, tables int, probes int, recall double, share double"
    )
    whole = {"functions": 0, "tables": 1, "probes": 1, "recall": 1.0, "share": 1.0}
    return shelves.join(plans, ["d", "shelf"], "left").drop("queries").fillna(whole)


def drawn(key: str, wanted: int, total: Column, seed: int) -> Column:
    """True for about `wanted` of `total` rows, by a hash of `key`; never where `total` is NULL."""
    part = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 30))
    return F.coalesce(part.cast("double") * total < F.lit(float(wanted)) * (1 << 30), F.lit(False))


def nearest_in(
    data: np.ndarray, ids: np.ndarray, asked: np.ndarray, k: int, turn: int = Settings().turn
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query the ids and scores of its k best rows, ties to the smaller id. A matrix product
    finds them, for `turn` queries at a time; the scores are then summed row by row, so that a pair
    has one score everywhere."""
    for begin in range(0, len(asked), turn):
        some = asked[begin : begin + turn]
        rough = some @ data.T
        for i in range(len(some)):
            if len(data) > k:
                bar = np.partition(rough[i], len(data) - k)[len(data) - k]
                at = np.flatnonzero(rough[i] >= bar - 1e-9 * (1 + abs(bar)))
            else:
                at = np.arange(len(data))
            score = (data[at] * some[i]).sum(1)
            order = np.lexsort((ids[at], -score))[:k]
            yield ids[at][order], score[order]


def dealt(data: DataFrame, asked: DataFrame, settings: Settings) -> DataFrame:
    """(key, part, turn, asks, cid, v): the rows of each key dealt over parts of about `block` and its
    queries over turns of about `queries`; each part of a key meets each of its turns. Both
    sides have cid, v and keys.

    Keys that need this are few, at most one per `block` entries, so they are sent to all tasks and
    rows are copied where they are: those of a hot key never come together before they are dealt.
    """
    left = data.select(F.explode("keys").alias("key"), F.lit(0).alias("asks"), "cid", "v")
    right = asked.select(F.explode("keys").alias("key"), F.lit(1).alias("asks"), "cid", "v")
    sizes = left.select("key", "asks").unionByName(right.select("key", "asks")).groupBy("key")
    crowds = sizes.agg(F.sum(1 - F.col("asks")).alias("rows"), F.sum("asks").alias("queries"))
    crowds = crowds.select(
        "key", F.ceil(F.col("rows") / settings.block).cast("int").alias("parts"),
        F.ceil(F.col("queries") / settings.queries).cast("int").alias("turns"),
    ).filter("parts > 1 or turns > 1")
    crowds = settle_table(crowds, "crowds")

    def spread(rows: DataFrame, own: str, other: str) -> DataFrame:
        """One of the `own` numbers by the id, and every one of the others."""
        rows = attach(rows, crowds, ["key"], settled=True)
        parts, copies = (F.greatest(F.coalesce(c, F.lit(1)), F.lit(1)) for c in (f"{own}s", f"{other}s"))
        return rows.select(
            "key", F.pmod(F.xxhash64("cid"), parts).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), copies - 1)).alias(other), "asks", "cid", "v",
        )

    return spread(left, "part", "turn").unionByName(spread(right, "turn", "part"))


def searched(data: DataFrame, asked: DataFrame, k: int, settings: Settings) -> DataFrame:
    """(q, cid, score): the k best of each query among the data rows of equal key. Both sides have
    cid, v and keys."""
    both = dealt(data, asked, settings).repartition("key", "part", "turn")
    both = both.select("key", "part", "turn", "asks", "cid", "v").sortWithinPartitions("key", "part", "turn", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches, 3):
            key, part, turn, asks, cid = (table.column(c).to_numpy() for c in range(5))
            new = (key[1:] != key[:-1]) | (part[1:] != part[:-1]) | (turn[1:] != turn[:-1])
            cuts = np.flatnonzero(np.r_[True, new, True])
            best: dict[int, list] = {}
            for begin, end in zip(cuts, cuts[1:], strict=False):
                first = begin + int(np.searchsorted(asks[begin:end], 1))
                if first == begin or first == end:
                    continue
                x, q = matrix(table.column(5).slice(begin, first - begin)), matrix(table.column(5).slice(first, end - first))
                for name, got in zip(cid[first:end], nearest_in(x, cid[begin:first], q, k, settings.turn), strict=True):
                    best.setdefault(int(name), []).append(got)
            yield from listed(best, k)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches, 1):
            best: dict[int, list] = {}
            for q, cids, scores in zip(*table.columns, strict=True):
                best.setdefault(q.as_py(), []).append((np.array(cids.values), np.array(scores.values)))
            yield from listed(best, k)

    found = both.mapInArrow(lean(run), FOUND).repartition("q").sortWithinPartitions("q").mapInArrow(lean(merge), FOUND)
    pairs = found.select("q", F.explode(F.arrays_zip("cids", "scores")).alias("p"))
    return pairs.select("q", F.col("p.cids").alias("cid"), F.col("p.scores").alias("score"))


FOUND = "q long, cids array<long>, scores array<double>"


def listed(best: dict[int, list], k: int) -> Iterator[pa.RecordBatch]:
    """One row per query: its k best of all lists found for it, each candidate once."""
    names, ids, scores = [], [], []
    for name, got in best.items():
        found, at = np.unique(np.concatenate([g[0] for g in got]), return_index=True)
        score = np.concatenate([g[1] for g in got])[at]
        order = np.lexsort((found, -score))[:k]
        names.append(name)
        ids.append(found[order])
        scores.append(score[order])
    if names:
        columns = [pa.array(names), pa.array(ids, pa.list_(pa.int64())), pa.array(scores, pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(columns, ["q", "cids", "scores"])


def search(
    vectors: DataFrame, asks: Column, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding",
    settings: Settings = Settings(),  # noqa: B008
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that `asks` holds for, its k nearest other rows by
    inner product, ties to the smaller id; all of them if there are fewer.

    Rows of a NULL id or an unusable vector take no part, rows that repeat id and vector count once,
    and only vectors of equal length are compared. Equal vectors are searched once: a class of them is
    one entry, which stands for its k + 1 smallest ids. Queries for which the probes met too few
    rows are searched among all, in blocks. A vector far longer than the rest has a shelf of its own and
    changes nothing for them; an empty table gives no rows.
    """
    rows = vectors.filter(F.col(vec_id).isNotNull() & usable(F.col(embedding)))
    rows = rows.select(F.col(vec_id).alias("id"), F.col(embedding).cast("array<double>").alias("v"), asks.alias("asks"))
    members = Window.partitionBy("v").orderBy("id")
    first = rows.select("v", "id").distinct().withColumn("__r", F.row_number().over(members)).filter(F.col("__r") <= k + 1)
    classes = first.groupBy("v").agg(F.min("id").alias("cid"), F.sort_array(F.collect_list("id")).alias("ids"))
    classes = settle_table(classes.select("cid", "v", "ids", norm_of(F.col("v")).alias("norm")), "vectors")
    queries = rows.filter("asks").select("id", "v").distinct().join(classes.select("cid", "v"), "v")
    queries = settle_table(queries.select("id", "cid", "v"), "queries")
    asked = queries.select("cid", "v").distinct()
    shelves = shelved(classes, settings)
    asking = asked.withColumn("d", F.size("v"))
    plans = settle_table(planned(shelves, asking, k, settings), "plans")
    data = attach(shelves, plans.select("d", "shelf", *Plan._fields[:4]), ["d", "shelf"]).filter("functions is not null")
    data = hashed(data, settings, False)
    probing = settle_table(hashed(asking.join(plans, "d"), settings, True), "probing")
    found = settle_table(searched(data, probing, k + 1, settings), "found")
    enough = found.join(classes.select("cid", F.size("ids").alias("m")), "cid").groupBy("q").agg(F.sum("m").alias("m"))
    # A query needs k other rows, or all others of its dimension; what it met may hold itself.
    held = classes.groupBy(F.size("v").alias("d")).agg(F.sum(F.size("ids")).alias("held"))
    needed = attach(asked.withColumn("d", F.size("v")), held, ["d"]).join(enough, F.col("cid") == F.col("q"), "left")
    short = needed.filter(F.coalesce("m", F.lit(0)) <= F.least(F.lit(k), F.col("held") - 1)).select("cid", "v")
    if not short.isEmpty():
        same = F.array(F.xxhash64(F.size("v"))).alias("keys")
        every = searched(classes.select("cid", "v", same), short.select("cid", "v", same), k + 1, settings)
        found = found.join(short.select(F.col("cid").alias("q")), "q", "left_anti").unionByName(every)
    # From classes back to rows: the ids of each class, without the query itself.
    pairs = found.join(classes.select("cid", "ids"), "cid").select("q", F.explode("ids").alias(vec_id), "score")
    pairs = queries.select(F.col("id").alias("query_id"), F.col("cid").alias("q")).join(pairs, "q")
    pairs = pairs.filter(F.col("query_id") != F.col(vec_id))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), vec_id)
    ranked = pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col(vec_id).alias("vec_id"), "score")
