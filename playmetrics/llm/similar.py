"""Join of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

A MinHash LSH forest: each text has a signature of `trees` x `depth` minima, and in every tree the
minima are a path from the root of a prefix trie. Per tree the paths are sorted, so that a node of the
trie is a run of neighbours. Prefixes are first matched at full length. What share of all links was
found that way follows from the similarities of the links found, and tree by tree the matched
prefix is shortened until that share reaches the target; only nodes whose children differ are looked
at again, and only for pairs that met nowhere before. Each candidate pair is verified once, exactly,
where it first meets, within blocks of a node, so that neither pairs nor groups are ever written out.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from playmetrics.llm.common import SPACES, lean, mix, sorted_groups, spans, text_bytes, word_bounds, word_hashes
from playmetrics.llm.components import components
from playmetrics.operators.sizing import attach, settle_table


class Settings(NamedTuple):
    """`recall`: the share of links that has to be found, as estimated from those found. `margin`: pairs
    whose signatures agree in a smaller share aren't verified. At 0.8 the share has a standard
    deviation of 0.045, so 0.55 loses a pair in about a hundred million."""

    words: int = 5
    similarity: tuple[int, int] = (4, 5)  # as a fraction, so that 0.8 is met exactly
    trees: int = 16
    depth: int = 5
    recall: float = 0.9997
    margin: float = 0.55
    block: int = 1024  # members of a node that are compared in one go
    crowd: int = 4096  # classes of more members are attached, not joined by their key
    bins: int = 40  # of the similarities found
    seed: int = 11


class Step(NamedTuple):
    """Lengths of the prefixes that are matched in each tree, now and in the step before (None: first)."""

    now: np.ndarray
    before: np.ndarray | None = None

    def lowered(self) -> np.ndarray:
        """The trees to look at."""
        return np.arange(len(self.now)) if self.before is None else np.flatnonzero(self.now < self.before)


def reached(similarity: np.ndarray, depths: np.ndarray) -> np.ndarray:
    """How likely pairs of these similarities meet in some tree."""
    return 1 - np.prod(1 - similarity[:, None] ** depths[None, :], axis=1)


def shortened(counts: np.ndarray, depths: np.ndarray, settings: Settings) -> np.ndarray:
    """Prefix lengths that reach the target recall, the longest of them shortened first. `counts` are
    the links found at `depths` by similarity, each taken for the lowest of its bin; a link of
    similarity s stands for 1 / reached(s) links. One more link at the threshold is always
    assumed, so few links or none are no reason to stop early."""
    least = settings.similarity[0] / settings.similarity[1]
    at = least + (1 - least) * np.arange(settings.bins) / settings.bins
    total = counts / reached(at, depths)
    total[0] += 1
    now = depths.copy()
    while now.max() > 1 and (total * reached(at, now)).sum() < settings.recall * total.sum():
        now[now.argmax()] -= 1
    return now


class Shingles(NamedTuple):
    """Of some texts: all shingles, where each text's begin, words per text, two keys of its words."""

    values: np.ndarray
    bounds: np.ndarray
    words: np.ndarray
    keys: np.ndarray


def shingled(data: np.ndarray, offsets: np.ndarray, width: int) -> Shingles:
    """Shingles of whole texts, in order. Fewer words than `width` are one shingle."""
    begins, ends, owner = word_bounds(data, offsets, ~SPACES[data])
    words = word_hashes(data, begins, ends)
    count = len(offsets) - 1
    sizes = np.bincount(owner, minlength=count)
    place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    total = words * np.uint64(0xD6E8FEB86659FD93)
    for k in range(1, min(width, len(words))):
        same = owner[:-k] == owner[k:]
        total[:-k] += np.where(same, mix(words[k:] + np.uint64(k)), np.uint64(0))
    whole = (place + width <= sizes[owner]) | ((place == 0) & (sizes[owner] < width))
    bounds = np.concatenate([[0], np.cumsum(np.bincount(owner[whole], minlength=count))])
    each = mix(words ^ (place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    keys = np.zeros((count, 2), np.uint64)
    some = sizes > 0
    if some.any():
        at = (np.cumsum(sizes) - sizes)[some]
        keys[some, 0] = np.add.reduceat(each, at)
        keys[some, 1] = np.add.reduceat(mix(each + np.uint64(7)), at) + sizes[some].astype(np.uint64)
    return Shingles(mix(total[whole]), bounds, sizes, keys)


def minima(shingles: Shingles, settings: Settings) -> np.ndarray:
    """(texts, trees * depth) of 32-bit minima; texts without shingles have the largest value."""
    random = np.random.default_rng(settings.seed)
    count = settings.trees * settings.depth
    factors = random.integers(0, 1 << 63, count, np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = random.integers(0, 1 << 63, count, np.uint64)
    out = np.full((len(shingles.words), count), 0xFFFFFFFF, np.uint32)
    some = np.flatnonzero(shingles.words)
    if len(some):
        at = shingles.bounds[:-1][some]
        for k in range(count):
            hashed = shingles.values * factors[k] + shifts[k]
            out[some, k] = np.minimum.reduceat((hashed >> np.uint64(32)).astype(np.uint32), at)
    return out


def signatures(docs: DataFrame, settings: Settings) -> DataFrame:
    """doc_id, n_words, k1, k2 (keys of the word sequence) and sig of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for a, b in spans(offsets, 1 << 19):
                s = shingled(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], settings.words)
                sig = minima(s, settings)
                keys = s.keys.view(np.int64)
                columns = [
                    batch.column(0).slice(a, b - a), pa.array(s.words.astype(np.int64)), pa.array(keys[:, 0].copy()),
                    pa.array(keys[:, 1].copy()), pa.array([r.tobytes() for r in sig], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "k1", "k2", "sig"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, n_words long, k1 long, k2 long, sig binary")


def prefix_keys(sig: np.ndarray, depths: np.ndarray, settings: Settings) -> np.ndarray:
    """(texts, trees): the tree and the first values of its path, as one number."""
    paths = sig.reshape(len(sig), settings.trees, settings.depth).astype(np.uint64)
    key = np.tile(np.arange(settings.trees, dtype=np.uint64), (len(sig), 1))
    for k in range(int(depths.max())):
        longer = depths > k
        key[:, longer] = mix(key[:, longer] * np.uint64(0x9E3779B97F4A7C15) ^ (paths[:, longer, k] + np.uint64(k)))
    return key.view(np.int64)


class Met(NamedTuple):
    """Prefixes of some texts, by which pairs that met before are told."""

    now: np.ndarray
    before: np.ndarray | None

    @classmethod
    def of(cls, sig: np.ndarray, step: Step, settings: Settings) -> Met:
        before = None if step.before is None else prefix_keys(sig, step.before, settings)
        return cls(prefix_keys(sig, step.now, settings), before)

    def earlier(self, tree: int, rows: np.ndarray | slice) -> np.ndarray:
        """Where these texts stand in what comes before `tree` in this step: all trees of the step
        before, and this step's trees up to it."""
        now = self.now[rows, :tree]
        return now if self.before is None else np.hstack([now, self.before[rows, tree:]])


def unpacked(column: pa.ChunkedArray | pa.Array, settings: Settings) -> np.ndarray:
    data, _ = text_bytes(column)
    return data.view(np.uint32).reshape(-1, settings.trees * settings.depth)


def paths(classes: DataFrame, step: Step, settings: Settings) -> DataFrame:
    """(node, rest, rep, key, tree): per class and tree looked at, the prefix matched now, what
    follows it, as bytes that sort like the values, and a number for the node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = unpacked(batch.column(1), settings)
            keys = prefix_keys(sig, step.now, settings)
            big = sig.reshape(len(sig), settings.trees, settings.depth).astype(">u4")
            for t in step.lowered().tolist():
                d = int(step.now[t])
                end = settings.depth if step.before is None else int(step.before[t])
                head = t.to_bytes(2, "big")
                node = [head + r.tobytes() for r in big[:, t, :d]]
                rest = [r.tobytes() for r in big[:, t, d:end]]
                columns = [
                    pa.array(node, pa.binary()), pa.array(rest, pa.binary()), batch.column(0), pa.array(keys[:, t].copy()),
                    pa.array(np.full(len(sig), t, np.int32)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["node", "rest", "rep", "key", "tree"])

    schema = "node binary, rest binary, rep long, key long, tree int"
    return classes.select("rep", "sig").mapInArrow(lean(run), schema)


def runs(sorted_paths: DataFrame, step: Step) -> DataFrame:
    """(key, tree, rep, part, nth, n): the members of trie nodes, found as runs of neighbours. Nodes of one
    member are left out, and below the first step also those with one child, whose pairs all met
    before. n is NULL for a run at the begin or end of its partition: it may go on in the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def found(table: pa.Table, begin: bool, end: bool) -> Iterator[pa.RecordBatch]:
            rows = np.arange(table.num_rows)
            key = table.column("key").to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(cuts, len(key)))
            which = np.repeat(np.arange(len(cuts)), size)
            many = size > 1
            if step.before is not None:
                code = table.column("rest").combine_chunks().dictionary_encode()
                code = (code.chunk(0) if isinstance(code, pa.ChunkedArray) else code).indices.to_numpy()
                many = np.maximum.reduceat(code, cuts) != np.minimum.reduceat(code, cuts)
            open_ = np.zeros(len(cuts), bool)
            open_[0] |= begin
            open_[-1] |= end
            kept = (many | open_)[which]
            n = pa.array(size[which][kept], mask=open_[which][kept], type=pa.int64())
            columns = [
                pa.array(key[kept]), table.column("tree").to_numpy()[kept], table.column("rep").to_numpy()[kept],
                np.full(int(kept.sum()), part, np.int32), (rows - cuts[which])[kept], n,
            ]
            if kept.any():
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "tree", "rep", "part", "nth", "n"])

        held, begin = None, True
        for table in sorted_groups(batches, 1, 1 << 16):
            if held is not None:
                yield from found(held, begin, False)
                begin = False
            held = table
        if held is not None:
            yield from found(held, begin, True)

    return sorted_paths.mapInArrow(lean(run), "key long, tree int, rep long, part int, nth long, n long")


def members_of_nodes(classes: DataFrame, step: Step, settings: Settings) -> DataFrame:
    """(key, tree, rep, nth, n) of all nodes with more than one member, n members each.

    The paths are range-partitioned with the class as the last part of the order, so a node of any
    size is spread over as many partitions as it fills. Only the first and last run of a partition can
    go on beyond it: their sizes, two rows per partition, are added up and broadcast.
    """
    order = ["node", "rest", "rep"]
    lines = paths(classes, step, settings).repartitionByRange(*order).sortWithinPartitions(*order)
    found = settle_table(runs(lines.select("key", "rest", "tree", "rep"), step), "runs")
    edges = found.filter("n is null")
    sizes = edges.groupBy("key", "part").agg(F.count(F.lit(1)).alias("c"))
    along, whole = W.partitionBy("key").orderBy("part"), W.partitionBy("key")
    sizes = sizes.select(
        F.col("key").alias("__key"), F.col("part").alias("__part"),
        (F.sum("c").over(along) - F.col("c")).alias("start"), F.sum("c").over(whole).alias("total"),
    )
    joined = edges.join(F.broadcast(sizes), (F.col("key") == F.col("__key")) & (F.col("part") == F.col("__part")))
    joined = joined.select("key", "tree", "rep", (F.col("nth") + F.col("start")).alias("nth"), F.col("total").alias("n"))
    inner = found.filter("n is not null").select("key", "tree", "rep", "nth", "n")
    return inner.unionByName(joined.filter("n > 1"))


def candidate_pairs(
    sig: np.ndarray, met: np.ndarray, part: np.ndarray, cross: bool, settings: Settings
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of members that share no column of `met` and whose signatures agree enough. `part` tells
    the two blocks of a node apart; with `cross` only pairs between them are asked for."""
    count, found = len(sig), []
    least = int(np.ceil(settings.margin * sig.shape[1]))
    left = np.flatnonzero(part == part.min()) if cross else np.arange(count)
    step = max(1, 40_000 // max(count, 1))
    for at in range(0, len(left), step):
        i = left[at : at + step]
        first = np.ones((len(i), count), bool)
        if cross:
            first &= (part != part.min())[None, :]
        else:
            first &= i[:, None] < np.arange(count)[None, :]
        for t in range(met.shape[1]):
            first &= met[i, t][:, None] != met[:, t][None, :]
            if not first.any():
                break
        a, b = np.nonzero(first)
        a = i[a]
        enough = (sig[a] == sig[b]).sum(1) >= least
        found.append((a[enough], b[enough]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def groups_of(table: pa.Table) -> Iterator[tuple[int, int]]:
    key, low, high = (table.column(c).to_numpy() for c in range(3))
    new = (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    cuts = np.flatnonzero(np.concatenate([[True], new, [True]]))
    yield from zip(cuts, cuts[1:], strict=False)


def candidates(placed: DataFrame, step: Step, settings: Settings) -> DataFrame:
    """The rows of `placed` (key, low, high, tree, block, rep, size, k1, sig), grouped by node and
    pair of blocks, that have a candidate partner there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches, 3):
            sig = unpacked(table.column(8), settings)
            met = Met.of(sig, step, settings)
            low, high, tree, block = (table.column(c).to_numpy() for c in range(1, 5))
            chosen = np.zeros(len(sig), bool)
            for a, b in groups_of(table):
                cross = low[a] != high[a]
                if b - a < 2 or cross and (block[a:b] == block[a]).all():
                    continue
                i, j = candidate_pairs(sig[a:b], met.earlier(int(tree[a]), slice(a, b)), block[a:b], cross, settings)
                chosen[a + i] = True
                chosen[a + j] = True
            if chosen.any():
                yield from table.filter(pa.array(chosen)).combine_chunks().to_batches()

    return grouped(placed).mapInArrow(lean(run), placed.schema)


def grouped(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "rep")


def shared_counts(values: np.ndarray, bounds: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many distinct shingles each pair shares. `values` holds each member's distinct shingles.
    Few pairs are intersected one by one; many by a product of 0/1 matrices, some columns at a time."""
    count = len(bounds) - 1
    if len(i) <= 8 * count:
        sets = {m: values[bounds[m] : bounds[m + 1]] for m in np.unique(np.concatenate([i, j]))}
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)])
    _, code, often = np.unique(values, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(count), np.diff(bounds))
    kept = often[code] > 1  # a shingle of one member is shared by no pair
    code = np.unique(code[kept], return_inverse=True)[1]
    owner = owner[kept]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    shared = np.zeros((count, count), np.float32)
    for at in range(0, int(code[-1]) + 1 if len(code) else 0, 2048):
        a, b = np.searchsorted(code, [at, at + 2048])
        part = np.zeros((count, 2048), np.float32)
        part[owner[a:b], code[a:b] - at] = 1
        shared += part @ part.T
    return shared[i, j].astype(np.int64)


def forest(i: np.ndarray, j: np.ndarray, count: int) -> list[tuple[int, int]]:
    """Pairs that hold together what the pairs (i, j) link: at most one per member."""
    root = np.arange(count)
    while True:  # every member takes the smallest of its partners' roots until nothing changes
        before = root.copy()
        np.minimum.at(root, i, root[j])
        np.minimum.at(root, j, root[i])
        root = root[root]
        if (root == before).all():
            break
    return [(k, int(r)) for k, r in enumerate(root) if r != k]


def verified(rows: DataFrame, step: Step, settings: Settings) -> DataFrame:
    """(a, b, links, bin): per member and group the weight of its verified partners (b NULL), pairs that
    hold linked members together, and, with a bin, how many pairs have such a similarity. `rows` are candidates with their text as the last column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        over, under = settings.similarity
        for table in sorted_groups(batches, 3, 1024):
            low, high, tree, block, rep, size, k1 = (table.column(c).to_numpy() for c in range(1, 8))
            sig = unpacked(table.column(8), settings)
            met = Met.of(sig, step, settings)
            data, offsets = text_bytes(table.column(9))
            sets: list[np.ndarray] = []
            right = np.zeros(len(sig), bool)
            for a, b in spans(offsets, 1 << 19):
                s = shingled(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], settings.words)
                sets += [np.unique(s.values[c:d]) for c, d in zip(s.bounds, s.bounds[1:], strict=False)]
                right[a:b] = s.keys[:, 0].view(np.int64) == k1[a:b]  # not another text of that id
            out: tuple[list, list, list, list] = ([], [], [], [])
            bins = np.zeros(settings.bins, np.int64)
            for a, b in groups_of(table):
                own = a + np.flatnonzero(right[a:b])
                own = own[np.unique(rep[own], return_index=True)[1]]
                cross = low[a] != high[a]
                if len(own) < 2 or cross and (block[own] == block[own[0]]).all():
                    continue
                i, j = candidate_pairs(sig[own], met.earlier(int(tree[a]), own), block[own], cross, settings)
                if not len(i):
                    continue
                n = np.array([len(sets[m]) for m in own])
                bounds = np.concatenate([[0], np.cumsum(n)])
                both = shared_counts(np.concatenate([sets[m] for m in own]), bounds, i, j)
                near = both * under >= over * (n[i] + n[j] - both)
                i, j, both = i[near], j[near], both[near]
                place = (both / (n[i] + n[j] - both) - over / under) / (1 - over / under) * settings.bins
                bins += np.bincount(np.clip(place.astype(np.int64), 0, settings.bins - 1), minlength=settings.bins)
                weight = np.bincount(i, size[own][j], len(own)) + np.bincount(j, size[own][i], len(own))
                ids = rep[own]
                for m in np.flatnonzero(weight):
                    for column, value in zip(out, (int(ids[m]), None, int(weight[m]), None), strict=True):
                        column.append(value)
                for u, v in forest(i, j, len(own)):
                    for column, value in zip(out, (int(ids[u]), int(ids[v]), None, None), strict=True):
                        column.append(value)
            for m in np.flatnonzero(bins):
                for column, value in zip(out, (None, None, int(bins[m]), int(m)), strict=True):
                    column.append(value)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["a", "b", "links", "bin"])

    return grouped(rows).mapInArrow(lean(run), "a long, b long, links long, bin long")


class Found(NamedTuple):
    """What the forest found, and the prefix lengths it ended with."""

    seen: DataFrame
    depths: tuple[int, ...]


def search(classes: DataFrame, docs: DataFrame, settings: Settings) -> Found:
    """All verified links of the classes (rep, size, k1, sig), step by step as prefixes get shorter."""
    texts = docs.select(F.col("doc_id").alias("rep"), "text")
    step = Step(np.full(settings.trees, settings.depth))
    counts = np.zeros(settings.bins)
    parts: list[DataFrame] = []
    while True:
        shared = members_of_nodes(classes, step, settings)
        shared = shared.withColumn("blocks", F.ceil(F.col("n") / settings.block).cast("int"))
        shared = shared.withColumn("block", F.floor(F.col("nth") / settings.block).cast("int"))
        shared = shared.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        placed = shared.join(classes, "rep").select(
            "key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "tree", "block",
            "rep", "size", "k1", "sig",
        )
        asked = candidates(placed, step, settings)
        rows = asked.join(texts, "rep").select(*asked.columns, "text")
        seen = settle_table(verified(rows, step, settings), "links")
        parts.append(seen)
        for r in seen.filter("bin is not null").groupBy("bin").agg(F.sum("links").alias("n")).collect():
            counts[r["bin"]] += r["n"]
        now = shortened(counts, step.now, settings)
        if (now == step.now).all():
            break
        step = Step(now, step.now)
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return Found(every.filter("bin is null"), tuple(step.now.tolist()))


def class_table(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From signatures: the documents (doc_id, k1, k2), and the classes of equal words (rep, size, k1, k2,
    sig), named after their smallest document."""
    wordy = found.filter("n_words > 0 and doc_id is not null")
    members = wordy.groupBy("doc_id").agg(F.min(F.struct("k1", "k2")).alias("k")).select("doc_id", "k.k1", "k.k2")
    sizes = members.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("size"))
    classes = sizes.join(
        wordy.select(F.col("doc_id").alias("rep"), "k1", "k2", "sig"), ["rep", "k1", "k2"]
    ).dropDuplicates(["rep"])
    return members, settle_table(classes.select("rep", "size", "k1", "k2", "sig"), "classes")


def join(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """doc_id, class_id and n_links for every row of `docs` (doc_id, text).

    n_links counts the other documents of similarity 0.8 or more; class_id is the smallest doc_id
    that links lead to. Texts of the same words are one class from the start and are compared
    once. A text without words (NULL, empty, blank) is linked to nothing and is its own class, a row
    without id has NULL and 0; rows that repeat an id are one document, with the text of the
    smallest key.
    """
    found = settle_table(signatures(docs, settings), "signatures")
    members, classes = class_table(found)
    seen = search(classes.drop("k2"), docs, settings).seen
    links = seen.filter("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    classed = components(seen.filter("b is not null").select(F.col("a").alias("u"), F.col("b").alias("v")))
    classed = classed.withColumnRenamed("node", "rep")
    # What a class has found, once per class; a class of many members meets them without a shuffle.
    figures = classes.select("rep", "size", "k1", "k2").join(links, "rep", "left").join(classed, "rep", "left")
    figures = settle_table(figures.select("k1", "k2", "rep", "size", "links", "component"), "figures")
    crowded = F.col("size") > settings.crowd
    told = attach(members, figures.filter(crowded), ["k1", "k2"])
    rest = told.filter("rep is null").select("doc_id", "k1", "k2").join(figures.filter(~crowded), ["k1", "k2"])
    every = told.filter("rep is not null").unionByName(rest, allowMissingColumns=True)
    every = every.select(
        F.col("doc_id").alias("__id"), F.coalesce("component", "rep").alias("__class"),
        (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("__links"),
    )
    ids = found.select("doc_id")
    out = ids.join(every, ids["doc_id"] == every["__id"], "left")
    return out.select(
        "doc_id", F.coalesce("__class", "doc_id").alias("class_id"), F.coalesce("__links", F.lit(0)).cast("long").alias("n_links")
    )


def keep_one(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """The rows of `docs` that are first of their class, with the columns they came with; rows
    without an id stay. Of rows that repeat an id all stay or all go."""
    gone = join(docs, settings).filter("class_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
