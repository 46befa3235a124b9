"""Best-fit packing of token sequences by linear grouping.

The plan is made from the histogram of piece lengths, which has at most `capacity` entries however
many documents there are: large lengths are rounded up within groups of equal cardinality, the few
rounded sizes are packed by configurations (patterns with a multiplicity), actual pieces take the
places of the rounded ones, and small pieces go best-fit into what is left. The pieces themselves
are numbered per length and looked up in the plan by Spark.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from playmetrics.llm.common import lean
from playmetrics.operators.sizing import settle_table

CAPACITY = 4096
END_ID = 1
STORE = 450_000
PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


class Recent(dict):
    """A store of at most twice `most` entries: when it is full, entries used since the last time
    stay reachable, the others go."""

    def __init__(self, most: int) -> None:
        self.most, self.older = most, {}

    def find(self, key: str) -> bytes | None:
        found = self.get(key)
        if found is None and (found := self.older.get(key)) is not None:
            self.keep(key, found)
        return found

    def keep(self, key: str, value: bytes) -> None:
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = value


# Words of these characters hold no white space, combining mark, apostrophe or letter of two small
# letters; the tokenizer takes their runs of letters, digits and runs of signs apart.
PLAIN = re.compile(r"(?:[!-&(-~]|[\u00C0-\u012F\u0131-\u017F])+")
RUNS = re.compile(r"[^\W\d_]+|\d|(?:[^\w]|_)+")
# Byte-level vocabularies write bytes as visible characters: visible ones as themselves, the others
# as those from U+0100 on in their order.
_VISIBLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_HIDDEN = [b for b in range(256) if b not in _VISIBLE]
SHOWN = {b: chr(256 + k) for k, b in enumerate(_HIDDEN)}


class WordIds(dict):
    """Ids of a blank-separated word as little-endian bytes. The tokenizer drops white space and
    looks at no word's neighbours, and within a word each run is looked up on its own in small
    letters: runs are kept, and words of plain characters are put together from them."""

    def __init__(self, path: str, words: int) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.words, self.runs = Tokenizer.from_file(path), words, Recent(words)
        self.model = self.tokenizer.model

    def run(self, text: str) -> bytes:
        found = self.runs.find(text)
        if found is None:
            shown = text if text.isascii() else text.encode().decode("latin-1").translate(SHOWN)
            found = np.array([t.id for t in self.model.tokenize(shown)], "<u4").tobytes()
            self.runs.keep(text, found)
        return found

    def __missing__(self, word: str) -> bytes:
        if len(word) > 64 or not PLAIN.fullmatch(word) or "<|" in word:
            return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        small = word.lower()
        found = self.run(small) if small.isalpha() else b"".join(map(self.run, RUNS.findall(small)))
        if len(self) >= self.words:
            self.clear()
        self[word] = found
        return found


@lru_cache(maxsize=2)
def word_ids(path: str, words: int) -> WordIds:
    """One store for all tasks that a Python worker runs."""
    return WordIds(path, words)


def pieces(
    docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, store: int = STORE
) -> DataFrame:
    """Pieces of at most `capacity` tokens of every document: its ids, then the end id.

    A NULL or empty text is the end id alone; NULL ids and repeated rows are documents of their own.
    `vocabulary` is the path of a tokenizer file that every executor has. Each Python worker keeps the
    ids of up to `store` words, and of twice as many runs within words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = word_ids(vocabulary, store).__getitem__
        end = np.array([end_id], "<u4").tobytes()
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = (text.as_py() or "").replace("\n", " ").split(" ")
                ids = b"".join(map(get, words)) + end
                for k in range(0, len(ids), 4 * capacity):
                    part = ids[k : k + 4 * capacity]
                    rows.append((doc_id, k // (4 * capacity), k // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types], names)

    return docs.select("doc_id", "text").mapInArrow(lean(run), PIECES)


# --- The plan: on counts per length only ---------------------------------------------------------


def grouped(counts: dict[int, int], groups: int) -> list[tuple[int, dict[int, int]]]:
    """Lengths in about `groups` groups of equal cardinality, longest first: the longest length,
    to which the group is rounded up, and what the group holds."""
    total, out, now, held = sum(counts.values()), [], {}, 0
    share = -(-total // groups)
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            take = min(left, share - held)
            now[length] = now.get(length, 0) + take
            held, left = held + take, left - take
            if held == share:
                out.append((max(now), now))
                now, held = {}, 0
    return out + ([(max(now), now)] if now else [])


def best_pattern(sizes: list[int], values: np.ndarray, capacity: int) -> tuple[float, list[int]]:
    """The most valuable set of sizes that fits: an unbounded knapsack over the capacity."""
    best = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1, np.int32)
    small, span = min(sizes), np.array(sizes)
    for room in range(small, capacity + 1):
        best[room] = best[room - 1]
        first = int(np.searchsorted(-span, -room))  # sizes are in descending order
        worth = best[room - span[first:]] + values[first:]
        k = int(np.argmax(worth))
        if worth[k] > best[room] + 1e-12:
            best[room], last[room] = worth[k], first + k
    pattern, room = [0] * len(sizes), capacity
    while room >= small:
        if last[room] < 0:
            room -= 1
        else:
            pattern[last[room]] += 1
            room -= sizes[last[room]]
    return float(best[capacity]), pattern


def configurations(sizes: list[int], need: list[int], capacity: int, rounds: int = 60) -> list[tuple[list[int], int]]:
    """Patterns over few sizes with their multiplicities: a linear programme solved by generating
    columns (a simplex basis kept as a matrix), rounded down; what remains is packed first-fit."""
    count = len(sizes)
    basis = np.diag([float(max(1, capacity // s)) for s in sizes])
    demand = np.array(need, float)
    x = np.linalg.solve(basis, demand)
    for _ in range(rounds * count):
        prices = np.linalg.solve(basis.T, np.ones(count))
        value, pattern = best_pattern(sizes, np.maximum(prices, 0), capacity)
        if value <= 1 + 1e-6:
            break
        column = np.linalg.solve(basis, np.array(pattern, float))
        usable = np.flatnonzero(column > 1e-9)
        if not len(usable):
            break
        steps = x[usable] / column[usable]
        out = usable[int(np.argmin(steps))]
        basis[:, out] = pattern
        x = np.maximum(np.linalg.solve(basis, demand), 0)
    left, chosen = list(need), []
    for k in np.argsort(-x, kind="stable"):
        pattern = [int(v) for v in basis[:, k].round()]
        times = int(x[k] + 1e-9)
        for p, n in zip(pattern, left, strict=True):
            times = min(times, n // p) if p else times
        if times > 0 and any(pattern):
            chosen.append((pattern, times))
            left = [n - times * p for n, p in zip(left, pattern, strict=True)]
    while any(left):  # each turn fills one pattern as often as what is left allows
        room, pattern = capacity, [0] * count
        for k, size in enumerate(sizes):
            pattern[k] = min(left[k], room // size)
            room -= pattern[k] * size
        times = min(n // p for n, p in zip(left, pattern, strict=True) if p)
        chosen.append((pattern, times))
        left = [n - times * p for n, p in zip(left, pattern, strict=True)]
    return chosen


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = 40, small: int | None = None) -> list[tuple]:
    """Where pieces go: (length, first number, how many, first sequence, offset). The k-th of them
    goes to the k-th sequence from the first on. `small`: shorter pieces are packed last."""
    small = capacity // 8 if small is None else small
    places: list[tuple] = []
    used: dict[int, int] = defaultdict(int)  # pieces of each length already placed
    blocks: list[tuple[int, int, int]] = []  # (room left, first sequence, how many sequences)
    sequence = 0

    def put(length: int, times: int, first: int, offset: int) -> None:
        places.append((length, used[length], times, first, offset))
        used[length] += times

    full = counts.get(capacity, 0)
    if full:
        put(capacity, full, 0, 0)
        sequence = full
    large = {n: c for n, c in counts.items() if small <= n < capacity and c}
    if large:
        held = grouped(large, groups)
        merged: dict[int, dict[int, int]] = {}
        for top, members in held:
            into = merged.setdefault(top, {})
            for n, c in members.items():
                into[n] = into.get(n, 0) + c
        sizes = sorted(merged, reverse=True)
        stock = [sorted(merged[s].items(), reverse=True) for s in sizes]
        for pattern, times in configurations(sizes, [sum(merged[s].values()) for s in sizes], capacity):
            slots = [k for k, n in enumerate(pattern) for _ in range(n)]
            # Cut the run of equal sequences where the actual length of a slot changes.
            parts: list[list[tuple[int, int]]] = []
            for k in slots:
                need, got = times, []
                while need:
                    length, there = stock[k][-1]
                    take = min(need, there)
                    got.append((length, take))
                    need -= take
                    stock[k].pop()
                    if there > take:
                        stock[k].append((length, there - take))
                parts.append(got)
            cuts = sorted({0, times} | {sum(c for _, c in got[: i + 1]) for got in parts for i in range(len(got))})
            at = [[0, got[0][1]] for got in parts]
            for begin, end in zip(cuts, cuts[1:], strict=False):
                offset = 0
                for s, got in enumerate(parts):
                    while at[s][1] <= begin:
                        at[s][0] += 1
                        at[s][1] += got[at[s][0]][1]
                    length = got[at[s][0]][0]
                    put(length, end - begin, sequence + begin, offset)
                    offset += length
                blocks.append((capacity - offset, sequence + begin, end - begin))
            sequence += times
    # Best fit, longest first: a run of equal pieces fills the tightest run of equal rooms.
    # Sequences that a whole block of large pieces could still enter are reopened by this as well.
    rooms = sorted(blocks)
    for length in sorted((n for n in counts if n < small), reverse=True):
        left = counts[length]
        while left:
            k = bisect_left(rooms, (length, -1, -1))
            if k == len(rooms):
                each = capacity // length
                new = -(-left // each)
                insort(rooms, (capacity, sequence, new))
                sequence += new
                continue
            room, first, many = rooms.pop(k)
            each = min(room // length, -(-left // many))
            if left < many:
                insort(rooms, (room, first + left, many - left))
                many, each = left, 1
            whole = min(each, left // many)
            for turn in range(whole):
                put(length, many, first, capacity - room + turn * length)
            left -= whole * many
            insort(rooms, (room - whole * length, first, many))
    return places


# --- The pieces meet the plan --------------------------------------------------------------------

PLACES = "length int, first_number long, times long, first_sequence long, offset int"


def pack(found: DataFrame, capacity: int = CAPACITY, groups: int = 40) -> DataFrame:
    """`sequence_id` and `offset` for every row of `found`, which has a `length` from 1 to
    `capacity`; its other columns stay. Without rows there are no sequences.

    The histogram (at most `capacity` rows) goes to the driver, and so does nothing else. Numbers
    within a length come from counts per task of the written pieces, so that no length, however
    frequent, meets in one task.
    """
    spark = found.sparkSession
    kept = [c for c in found.columns if c != "__task"]
    tasked = settle_table(found.select(*kept, F.spark_partition_id().alias("__task")), "pieces")
    sizes = tasked.groupBy("length", "__task").agg(F.count(F.lit(1)).alias("__n"))
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("__n").alias("n")).collect()}
    places = spark.createDataFrame(plan(counts, capacity, groups), PLACES)
    by_task = Window.partitionBy("length").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "__task", F.coalesce(F.sum("__n").over(by_task), F.lit(0)).alias("__before"))
    within = Window.partitionBy("__task", "length").orderBy(*[F.col(f"`{c}`") for c in kept if c != "length"])
    numbered = tasked.withColumn("__k", F.row_number().over(within) - 1).join(starts, ["length", "__task"])
    numbered = numbered.withColumn("__number", F.col("__before") + F.col("__k")).drop("__before", "__k", "__task")
    # The plan has at most a few rows for each of `capacity` lengths and pattern slots: it is as
    # large for any input, so it may be broadcast.
    plan_rows = F.broadcast(places.withColumnRenamed("length", "__length").withColumnRenamed("offset", "__offset"))
    inside = (F.col("length") == F.col("__length")) & F.col("__number").between(
        F.col("first_number"), F.col("first_number") + F.col("times") - 1
    )
    placed = numbered.join(plan_rows, inside)
    sequence = F.col("first_sequence") + F.col("__number") - F.col("first_number")
    return placed.select(*kept, sequence.alias("sequence_id"), F.col("__offset").cast("long").alias("offset"))


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, store: int = STORE) -> DataFrame:
    """One row per piece of every document: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    found = pack(pieces(docs, vocabulary, capacity, store=store), capacity)
    return found.select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset"
    )
