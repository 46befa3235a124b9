"""Prefix trie of conversations, as balanced parentheses per shard.

Every distinct sequence of turns is one path. The paths are sorted and cut into shards, and each shard
writes its part of the trie as parentheses, one pair per node in depth-first order. All a node needs
is then a difference of two cumulative arrays: `findclose` gives the end of its subtree, found by the
smallest and largest excess of blocks of parentheses; the rank of `()` counts its leaves; sums over the
opening parentheses give its conversations and savings.

Paths of one subtree are neighbours in the order, so only nodes on the path to a shard's border can
have a part of their subtree elsewhere: the spine. A node belongs to the first shard that has
it. With that, every figure of a spine node is the sum of its figures in the shards, and
spines merge by one aggregate over their nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from playmetrics.llm.common import trim
from playmetrics.operators.sizing import attach, settle_table

KEY = 16
SHARD_NODES = 200_000
# Paths are dealt by their first bytes: this many turns.
DEALT_TURNS = 64
LIST_BYTES = 1 << 16
BLOCK = 64
FAN = 8
NOBODY = hashlib.sha256(b"").hexdigest()

NODE_FIELDS = [
    ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()),
    ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()),
    ("node_id", pa.binary()), ("parent_id", pa.binary()),
]
NODES = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends_sha256 string, node_id binary, parent_id binary"
)


# --- Conversations as paths ------------------------------------------------------------------------


def turn_key(role: Column, text: Column) -> Column:
    """128 bits of the SHA-256 of a turn: equal keys stand for equal turns."""
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return F.unhex(F.substring(F.sha2(whole, 256), 1, 2 * KEY))


def turn_lists(turns: DataFrame) -> DataFrame:
    """One row per conv_id with its turns in order: key and code points of each, no texts.

    Turns are ordered by `turn`, NULL first; turns of one number by their key. Rows without a conv_id
    belong to no conversation. A conversation's keys, about 30 bytes per turn, are one row.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    keyed = turns.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").alias("turn"), turn_key(role, text).alias("key"), F.length(text).alias("chars")
        ).alias("t"),
    )
    listed = keyed.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("list"))
    return listed.select("conv_id", F.transform("list", lambda t: F.struct(t["key"], t["chars"])).alias("turns"))


def shared_heads(lists: DataFrame, base: Column, head: Column, longest: int) -> DataFrame:
    """Each conversation's first `head` turns replaced by those of the conversation `base`: all it has
    if fewer, none if it does not exist. `longest` bounds `head`, so only that much of a base moves."""
    heads = lists.select(F.col("conv_id").alias("__base"), F.slice("turns", 1, longest).alias("__head"))
    named = lists.select("conv_id", "turns", base.alias("__of"), head.cast("int").alias("__n"))
    joined = named.join(heads, F.col("__of") == F.col("__base"), "left")
    nothing = F.array().cast(lists.schema["turns"].dataType)
    first = F.when(F.col("__n") > 0, F.slice(F.coalesce("__head", nothing), F.lit(1), F.col("__n"))).otherwise(nothing)
    own = F.slice("turns", F.col("__n") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return joined.select("conv_id", F.concat(first, own).alias("turns"))


def joined_ids(members: DataFrame) -> DataFrame:
    """Per path: SHA-256 of its conv_ids in numeric order, joined by commas.

    The ids are sorted over all tasks and put together into lists of some 64 KB there; a path's lists then
    go through one task as a stream. So a path that a third of all conversations share costs that task
    its lists' bytes, one list at a time.
    """
    order = ["path_id", "conv_id"]
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[str, int, str]] = []
        path, first, ids, size = None, 0, [], 0
        for batch in batches:
            for p, c in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                if p != path or size > LIST_BYTES:
                    if ids:
                        out.append((path, first, ",".join(ids)))
                    path, first, ids, size = p, c, [], 0
                    if len(out) >= 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["p", "c", "ids"])
                        out = []
                ids.append(str(c))
                size += len(ids[-1]) + 1
        if ids:
            out.append((path, first, ",".join(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["p", "c", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, digest = None, hashlib.sha256()
        for batch in batches:
            out = []
            for p, _, ids in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if p == path:
                    digest.update(b",")
                else:
                    if path is not None:
                        out.append((path, digest.hexdigest()))
                    path, digest = p, hashlib.sha256()
                digest.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["path_id", "ends"])
        if path is not None:
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([digest.hexdigest()])], ["path_id", "ends"])

    ordered = members.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    some = ordered.select(*order).mapInArrow(lists, "path_id string, conv_id long, ids string")
    return some.repartition("path_id").sortWithinPartitions(*order).mapInArrow(digests, "path_id string, ends string")


# --- Balanced parentheses --------------------------------------------------------------------------


class Parentheses:
    """A balanced sequence (1 opens, 0 closes) with the least and largest excess of its blocks."""

    def __init__(self, opens: np.ndarray) -> None:
        self.opens = opens.astype(bool)
        self.excess = np.cumsum(np.where(self.opens, 1, -1))
        # Level 0 has the parentheses themselves, level 1 their blocks, and so on in groups of FAN.
        self.low, self.high = [self.excess], [self.excess]
        self.fans = [BLOCK]
        while len(self.low[-1]) > 1:
            fan = self.fans[-1]
            starts = np.arange(0, len(self.low[-1]), fan)
            self.low.append(np.minimum.reduceat(self.low[-1], starts))
            self.high.append(np.maximum.reduceat(self.high[-1], starts))
            self.fans.append(FAN)
        pairs = np.append(self.opens[:-1] & ~self.opens[1:], False)
        self.open_rank = np.cumsum(self.opens)
        self.leaf_rank = np.cumsum(pairs)

    def findclose(self, at: np.ndarray) -> np.ndarray:
        """Where the parentheses opened at these positions close: the first later position whose excess
        falls below that of the opening one. All are looked for at once: up past blocks whose excess
        stays above, then down into the first that reaches it."""
        wanted = self.excess[at] - 1
        here, level = at + 1, np.zeros(len(at), np.int64)
        found = np.zeros(len(at), bool)
        open_ = np.arange(len(at))
        while len(open_):
            for lv in range(len(self.low)):
                mine = open_[level[open_] == lv]
                if not len(mine):
                    continue
                place = here[mine]
                reached = (self.low[lv][place] <= wanted[mine]) & (wanted[mine] <= self.high[lv][place])
                hit, miss = mine[reached], mine[~reached]
                if lv == 0:
                    found[hit] = True
                else:
                    level[hit] = lv - 1
                    here[hit] *= self.fans[lv - 1]
                here[miss] += 1
                # At the end of a group the search goes on with what follows the group, one level up.
                last = miss[here[miss] % self.fans[lv] == 0] if lv + 1 < len(self.low) else miss[:0]
                level[last] += 1
                here[last] //= self.fans[lv]
            open_ = open_[~found[open_]]
        return here


def least_of(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The smallest value of each [begin, end), by tables over powers of two."""
    size = end - begin
    power = np.floor(np.log2(size)).astype(np.int64)
    out = np.empty(len(begin), values.dtype)
    table = values
    for k in range(int(power.max(initial=0)) + 1):
        mine = power == k
        out[mine] = np.minimum(table[begin[mine]], table[end[mine] - (1 << k)])
        table = np.minimum(table[: -(1 << k)], table[1 << k :]) if len(table) > 1 << k else table
    return out


def common(a: bytes, b: bytes) -> int:
    """Turns that two paths share at their begin."""
    n = min(len(a), len(b)) // KEY
    if a[: n * KEY] == b[: n * KEY]:
        return n
    low, high = 0, n
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if a[: middle * KEY] == b[: middle * KEY] else (low, middle)
    return low


def shard_nodes(
    paths: list[bytes], chars: list[np.ndarray], counts: np.ndarray, firsts: np.ndarray, ends: list[str],
    before: bytes | None, after: bytes | None,
) -> dict[str, list | np.ndarray]:
    """All nodes of the sorted distinct `paths` of a shard. `before` and `after` are the neighbour shards'
    nearest paths; nodes on them get an id, and their figures are this shard's part."""
    shared = [0, *(common(a, b) for a, b in zip(paths, paths[1:], strict=False))]
    depths = np.array([len(p) // KEY for p in paths])
    shared_left, shared = -1 if before is None else common(before, paths[0]), np.array(shared)
    shared_right = -1 if after is None else common(paths[-1], after)

    # A path closes what it does not share with the one before it and opens what is new.
    new = depths - shared
    new[0] += 1  # the root
    closed = np.concatenate([[0], depths[:-1] - shared[1:]])
    total = int(new.sum())
    runs = np.stack([closed, new], 1).ravel()
    signs = np.tile([False, True], len(paths))
    opens = np.concatenate([np.repeat(signs, runs), np.zeros(2 * total - int(runs.sum()), bool)])
    tree = Parentheses(opens)
    at = np.flatnonzero(opens)
    close = tree.findclose(at)
    begin = np.arange(total)
    end = tree.open_rank[close]
    path_of = np.repeat(np.arange(len(paths)), new)
    last = np.cumsum(new) - 1  # each path's last node, unless it is a node of an earlier path: never
    depth = depths[path_of] - (last[path_of] - begin)

    width = np.zeros(total, np.int64)
    for k, own in enumerate(chars):
        if new[k]:
            width[last[k] - new[k] + 1 : last[k] + 1] = own[-int(new[k]) :] if k else np.concatenate([[0], own])

    members, least = np.zeros(total, np.int64), np.full(total, np.iinfo(np.int64).max)
    members[last], least[last] = counts, firsts
    through = np.concatenate([[0], np.cumsum(members)])
    n_convs = through[end] - through[begin]
    conv_id = least_of(least, begin, end)

    # The parent is the nearest node before it that is not closed yet: of the nodes one step less deep the last.
    order = np.lexsort((begin, depth))
    key = depth[order].astype(np.int64) * (total + 1) + begin[order]
    parent = np.full(total, -1)
    deeper = depth > 0
    parent[deeper] = order[np.searchsorted(key, (depth[deeper] - 1) * (total + 1) + begin[deeper]) - 1]

    owned = ~((path_of == 0) & (depth <= shared_left))
    n_children = np.bincount(parent[owned & deeper], minlength=total)
    leaves = tree.leaf_rank[close] - tree.leaf_rank[at] + (tree.opens[at] & ~tree.opens[np.minimum(at + 1, len(opens) - 1)])
    spine_right = np.zeros(total, bool)
    if shared_right >= 0:
        up = last[-1]
        while up >= 0:
            spine_right[up] = depth[up] <= shared_right
            if shared_right == depths[-1]:  # the next shard goes on from the last path: no leaf
                leaves[up] -= 1
            up = parent[up]
    weight = np.concatenate([[0], np.cumsum(n_convs * width - owned * width)])
    spine = spine_right | ~owned

    lists = [""] * total
    for k, x in zip(last.tolist(), ends, strict=True):
        lists[k] = x

    def prefix(node: int) -> bytes:
        return hashlib.sha256(paths[path_of[node]][: int(depth[node]) * KEY]).digest()

    node_ids: list[bytes | None] = [None] * total
    for k in np.flatnonzero(spine).tolist():
        node_ids[k] = prefix(k)
    return {
        "conv_id": conv_id, "depth": depth, "parent_conv_id": pa.array(np.where(deeper, conv_id[parent], 0), mask=~deeper),
        "n_convs": n_convs, "n_children": n_children, "n_leaves": leaves, "saved_tokens": weight[end] - weight[begin],
        "ends_sha256": pa.array([x or None for x in lists], pa.string()), "node_id": pa.array(node_ids, pa.binary()),
        "parent_id": pa.array([node_ids[p] if p >= 0 else None for p in parent.tolist()], pa.binary()),
    }


# --- The trie ----------------------------------------------------------------------------------------


def dealt(paths: DataFrame, shards: int) -> DataFrame:
    """The distinct paths with the number of their shard; shards follow the order of the paths."""
    ranged = paths.withColumn("__start", F.substring("path", 1, DEALT_TURNS * KEY)).repartitionByRange(shards, "__start")
    return settle_table(ranged.withColumn("shard", F.spark_partition_id()).drop("__start"), "shards")


def trie(lists: DataFrame, shard_size: int = SHARD_NODES) -> DataFrame:
    """All nodes of the trie of conversations given as rows (conv_id, turns), one per conv_id.

    Returns conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256 per node; the root is there if there is any conversation.
    """
    keyed = lists.select(
        "conv_id",
        F.coalesce(F.expr("array_join(transform(turns, t -> hex(t.key)), '')"), F.lit("")).alias("__hex"),
        F.transform("turns", lambda t: t["chars"]).alias("chars"),
    )
    members = settle_table(
        keyed.select("conv_id", F.unhex("__hex").alias("path"), F.sha2("__hex", 256).alias("path_id"), "chars"), "members"
    )
    # Copies of a conversation are one path, counted in each task before the shuffle.
    paths = members.groupBy("path_id").agg(
        F.first("path").alias("path"), F.first("chars").alias("chars"),
        F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("first_id"),
    )
    total = paths.agg(F.sum(F.length("path") / KEY + 1).alias("n")).first()["n"] or 0
    count = max(1, -(-int(total) // shard_size))
    shards = dealt(paths.join(joined_ids(members), "path_id").drop("path_id"), count)

    # One row per shard: its nearest neighbours' paths.
    along = W.orderBy("shard")
    borders = shards.groupBy("shard").agg(F.min("path").alias("least"), F.max("path").alias("most"))
    borders = borders.select("shard", F.lag("most").over(along).alias("before"), F.lead("least").over(along).alias("after"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema(NODE_FIELDS)
        if not left.num_rows:
            return schema.empty_table()
        given = left.select(["path", "chars", "n", "first_id", "ends"]).to_pydict()
        order = sorted(range(left.num_rows), key=given["path"].__getitem__)
        neighbours = right.to_pylist()[0]
        found = shard_nodes(
            [given["path"][i] for i in order], [np.array(given["chars"][i], np.int64) for i in order],
            np.array(given["n"])[order], np.array(given["first_id"])[order], [given["ends"][i] for i in order],
            neighbours["before"], neighbours["after"],
        )
        table = pa.table([pa.array(found[n]).cast(t) for n, t in NODE_FIELDS], schema=schema)
        trim()
        return table

    nodes = settle_table(shards.groupBy("shard").cogroup(borders.groupBy("shard")).applyInArrow(run, NODES), "nodes")
    figures = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    spines = settle_table(
        nodes.filter("node_id IS NOT NULL").groupBy("node_id", "parent_id", "depth").agg(
            F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in figures],
            F.max("ends_sha256").alias("ends_sha256"),
        ), "spines",
    )
    columns = ["conv_id", "depth", "parent_conv_id", *figures, "ends_sha256"]
    below = nodes.filter("node_id IS NULL AND parent_id IS NOT NULL").drop("parent_conv_id")
    parents = spines.select(F.col("node_id").alias("id"), F.col("conv_id").alias("parent_conv_id"))
    named = attach(
        spines.select(*below.columns).unionByName(below), settle_table(parents, "parents"), {"parent_id": "id"}, settled=True
    )
    whole = nodes.filter("node_id IS NULL AND parent_id IS NULL").select(*columns).unionByName(named.select(*columns))
    return whole.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOBODY)))


def conversation_trie(turns: DataFrame, shard_size: int = SHARD_NODES) -> DataFrame:
    """The trie of the rebuilt conversations of `turns` (conv_id, turn, role, text): every conversation c
    begins with the first crc32(c) % 6 turns of conversation c - c % 100.

    A NULL role or text is empty; turns are ordered by `turn`, NULL first, and turns of one number by the
    digest of role and text, so repeated rows are turns of their own. Rows without a conv_id belong to
    no conversation. A conversation whose turns all go is a member of the root only. An empty
    table gives no rows. Texts of any length count whole. Other columns take no part.
    """
    lists = settle_table(turn_lists(turns), "turns")
    conv = F.col("conv_id")
    head = F.crc32(conv.cast("string").cast("binary")) % 6
    return trie(shared_heads(lists, conv - conv % 100, head, 5), shard_size)
