"""The conversation trie against a plain one."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from playmetrics.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, n_convs string"


def key(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[: trie.KEY]


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, key(role, text), role, text))
    own = {c: [(r, t) for *_, r, t in sorted(turns)] for c, turns in own.items()}
    members = defaultdict(list)
    ends = defaultdict(list)
    for c, turns in own.items():
        head = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        built = tuple(own.get(base, [])[:head] + turns[head:])
        for d in range(len(built) + 1):
            members[built[:d]].append(c)
        ends[built].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        kids = children[p]
        leaves[p] = sum(leaves[k] for k in kids) if kids else 1
        own_saved = (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        saved[p] = own_saved + sum(saved[k] for k in kids)
    return sorted(
        (
            min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children[p]),
            leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest(),
        )
        for p in members
    )


def made(seed, convs, words, longest):
    """Few different turns, so that many prefixes are shared."""
    rng = random.Random(seed)
    rows = []
    for _ in range(convs):
        c = rng.choice([rng.randrange(400), rng.randrange(10**12), -rng.randrange(500)])
        for turn in range(rng.randrange(1, longest)):
            text = rng.choice(["é" * rng.randrange(1, 1 + words), "", None])
            rows.append((c, rng.choice([turn, turn, turn, None, 3]), rng.choice(["user", None]), text, "clash"))
    return [*rows, (None, 1, "user", "lost", "x")]


def found(spark, rows, shard_size):
    nodes = trie.conversation_trie(spark.createDataFrame(rows, SCHEMA), shard_size)
    return sorted(map(tuple, nodes.collect()))


@pytest.mark.parametrize("shard_size", [7, 60, trie.SHARD_NODES])
def test_same_as_plain(spark, shard_size):
    rows = made(1, 150, 2, 9)
    assert found(spark, rows, shard_size) == plain(rows)


def test_deep_and_hot(spark):
    """One conversation of many turns, a copy of it that goes on, and one that most share."""
    long = [(5_000, t, "user", str(t % 7), "x") for t in range(1500)]
    longer = [(70_000, t, "user", str(t % 7), "x") for t in range(1502)]
    hot = [(c, t, "user", "same", "x") for c in range(100_000, 103_000, 100) for t in range(3)]
    rows = [*long, *longer, *hot, (7, 0, None, None, "x"), (13, 0, "user", "alone", "x")]
    for shard_size in (40, trie.SHARD_NODES):
        assert found(spark, rows, shard_size) == plain(rows)


def test_small_lists_of_ids(spark, monkeypatch):
    monkeypatch.setattr(trie, "LIST_BYTES", 5)
    rows = [(c, 0, "user", "same", "x") for c in range(0, 20_000, 100)]
    assert found(spark, rows, trie.SHARD_NODES) == plain(rows)


def test_empty_table(spark):
    assert found(spark, [], trie.SHARD_NODES) == []
    assert found(spark, [(None, 1, "a", "b", "c")], trie.SHARD_NODES) == []


@pytest.mark.parametrize("seed", range(5))
def test_findclose(seed):
    rng = random.Random(seed)
    opens, depth, left = [], 0, 3000
    while left or depth:
        up = left and (not depth or rng.random() < (0.9 if seed % 2 else 0.5))
        opens.append(bool(up))
        depth += 1 if up else -1
        left -= bool(up)
    stack, close = [], {}
    for i, up in enumerate(opens):
        if up:
            stack.append(i)
        else:
            close[stack.pop()] = i
    tree = trie.Parentheses(np.array(opens))
    at = np.flatnonzero(opens)
    assert tree.findclose(at).tolist() == [close[i] for i in at.tolist()]
