"""Exact removal of repeated passages with a distributed suffix array.

A byte goes if some string of `length` bytes around it starts earlier as well (smaller doc_id, or
the same document further ahead). Every such string is found through a suffix chosen by its own
content, so that equal strings choose alike: the place of its smallest 32-byte hash, or 35 bytes
before that. Only those suffixes are sorted that begin with 66 bytes which occur more than once.

Tasks sort their suffixes, join equal contexts into one and exchange the sorted runs front-coded
(length of the common prefix with the one before, and the rest). A loser tree merges the runs of a
range; its comparisons start with the common prefixes that are known and look only at bytes behind
them. The merged order with its common prefixes tells which suffixes share how much to the right;
what stands on their left settles the strings that begin before them.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playmetrics.llm.common import MULTIPLIER, NO_ID, about, lean, mix, sorted_groups, spans, text_bytes, trim

LENGTH = 100  # bytes of a string that counts as repeated
GRAM = 32
HALF = (LENGTH - GRAM + 1) // 2 + 1  # 35: strings that begin so many bytes before the smallest hash
CORE = LENGTH - HALF + 1  # 66: bytes that equal strings share from their suffix on, at least
BUCKET_BITS = 20
PLACE_BITS = 40


class Suffixes(NamedTuple):
    """Suffixes of a piece of text: where each begins, how many bytes before it the strings begin
    that chose it (from `low` to `high`), and a hash of the bytes that all of those share."""

    start: np.ndarray
    low: np.ndarray
    high: np.ndarray
    core: np.ndarray


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A hash of the `width` bytes from each place on, as far as they go."""
    out = np.zeros(max(0, len(data) - width + 1), np.uint64)
    if not len(out):
        return out
    part, span, factor, done, total = data.astype(np.uint64) + np.uint64(1), 1, MULTIPLIER, 0, out
    rest = width
    while rest:
        if rest & 1:  # append the next `span` bytes to what is there
            total = total * np.uint64(factor) + part[done : done + len(out)]
            done += span
        rest >>= 1
        if rest:
            part = part[: len(part) - span] * np.uint64(factor) + part[span:]
            factor, span = factor * factor % (1 << 64), 2 * span
    return mix(total)


def suffixes(data: np.ndarray, offsets: np.ndarray, block: int = 1 << 18) -> Suffixes:
    """The suffixes that the strings of all texts choose; strings never cross a text's end. Long
    texts are worked through `block` strings at a time."""
    parts = [_suffixes(data, offsets, at, block) for at in range(0, len(data) - LENGTH + 1, block)]
    parts = parts or [Suffixes(*[np.zeros(0, np.int64)] * 3, np.zeros(0, np.uint64))]
    return Suffixes(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def _suffixes(data: np.ndarray, offsets: np.ndarray, at: int, block: int) -> Suffixes:
    part = data[at : at + block + LENGTH - 1]
    hashes = window_hashes(part, GRAM)
    where = leftmost(hashes, LENGTH - GRAM + 1)
    inside = np.ones(len(where), bool)
    first, last = np.searchsorted(offsets, [at + 1, at + len(part)])
    for end in offsets[first:last] - at:  # strings that would cross into the next text
        inside[max(0, end - LENGTH + 1) : end] = False
    begin = np.flatnonzero(inside)
    where = where[begin]
    offset = where - begin
    far = offset >= HALF
    start = where - HALF * far
    offset = offset - HALF * far
    # Strings that follow each other and chose the same suffix are one entry.
    apart = np.concatenate([[True], (start[1:] != start[:-1]) | (begin[1:] != begin[:-1] + 1)])[: len(begin)]
    new = np.flatnonzero(apart)
    end = np.concatenate([new[1:], [len(begin)]])[: len(new)] - 1
    start = start[new]
    core = window_hashes(part, CORE)[start] if len(start) else np.zeros(0, np.uint64)
    return Suffixes(start + at, offset[end], offset[new], core)


def leftmost(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each window the first place that has its minimum."""
    place = np.arange(len(hashes))
    span, values, at = 1, hashes, place

    def better(v: np.ndarray, a: np.ndarray, by: int) -> tuple[np.ndarray, np.ndarray]:
        left, right = v[: len(v) - by], v[by:]
        take = right < left
        return np.where(take, right, left), np.where(take, a[by:], a[: len(a) - by])

    while span * 2 <= width:
        values, at = better(values, at, span)
        span *= 2
    return better(values, at, width - span)[1] if width > span else at


def packed(hashes: np.ndarray, bucket: np.ndarray | int) -> np.ndarray:
    """Hash and bucket in one number: the hash only filters, so that few bits of it may go."""
    high = hashes >> np.uint64(BUCKET_BITS + 1) << np.uint64(BUCKET_BITS)
    return (high | np.asarray(bucket, np.uint64)).view(np.int64)


# --- Runs ----------------------------------------------------------------------------------------


def common(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each padded row with the one before."""
    out = np.zeros(len(rows), np.int64)
    for at in range(1, len(rows), 8192):
        to = min(len(rows), at + 8192)
        differ = rows[at:to] != rows[at - 1 : to - 1]
        first = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
        out[at:to] = np.minimum(first, np.minimum(sizes[at:to], sizes[at - 1 : to - 1]))
    return out


class Run(NamedTuple):
    """Sorted suffixes, each with the text on its left: `right` and `left` hold the bytes padded to a
    fixed width, left ones end at the suffix."""

    right: np.ndarray
    left: np.ndarray
    right_size: np.ndarray
    left_size: np.ndarray
    doc: np.ndarray
    place: np.ndarray


def contexts(data: np.ndarray, found: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """The bytes right and left of each suffix that its strings take up, padded with 0."""
    steps = np.arange(LENGTH)
    right = data[np.minimum(found.start[:, None] + steps, len(data) - 1)]
    right[steps[None, :] >= (LENGTH - found.low)[:, None]] = 0
    back = np.arange(HALF)
    left = data[np.maximum(found.start[:, None] - HALF + back, 0)]
    left[back[None, :] < (HALF - found.high)[:, None]] = 0
    return right, left


def dump(run: Run) -> bytes:
    """Front-coded and compressed."""
    import zstandard

    prefix = common(run.right, run.right_size)
    steps = np.arange(LENGTH)
    kept = (steps[None, :] >= prefix[:, None]) & (steps[None, :] < run.right_size[:, None])
    shown = np.arange(HALF)[None, :] >= (HALF - run.left_size)[:, None]
    out = io.BytesIO()
    sizes = [prefix, run.right_size, run.left_size]
    parts = [x.astype(np.uint8) for x in sizes] + [run.right[kept], run.left[shown], run.doc, run.place]
    for part in parts:
        np.save(out, part, allow_pickle=False)
    return zstandard.ZstdCompressor(level=1).compress(out.getvalue())


class Coded(NamedTuple):
    """A run as it travels: prefixes and rests, not yet put together."""

    prefix: np.ndarray
    right_size: np.ndarray
    left: np.ndarray
    left_size: np.ndarray
    doc: np.ndarray
    place: np.ndarray
    rest: bytes


def undump(raw: bytes) -> Coded:
    import zstandard

    data = io.BytesIO(zstandard.ZstdDecompressor().decompress(raw))
    prefix, right_size, left_size, rest, left, doc, place = (np.load(data, allow_pickle=False) for _ in range(7))
    whole = np.zeros((len(prefix), HALF), np.uint8)
    whole[np.arange(HALF)[None, :] >= (HALF - left_size.astype(int))[:, None]] = left
    return Coded(prefix, right_size, whole, left_size, doc, place, rest.tobytes())


def unfolded(run: Coded) -> Iterator[tuple[int, bytes]]:
    """Each suffix with the length of its common prefix with the one before."""
    now, at = b"", 0
    for prefix, size in zip(run.prefix.tolist(), run.right_size.tolist(), strict=True):
        now = now[:prefix] + run.rest[at : at + size - prefix]
        at += size - prefix
        yield prefix, now


def merged(runs: list[Coded]) -> tuple[np.ndarray, np.ndarray]:
    """The runs in one order: the run of each suffix, and its common prefix with the one before.

    A loser tree. Each contender knows how long a prefix it shares with the suffix put out last. The
    longer prefix wins without a look at any byte; of equally long ones, the bytes behind are
    compared, and the loser then knows its prefix with the winner.
    """
    count = len(runs)
    streams = [unfolded(r) for r in runs]
    known, now = [0] * count, [b""] * count
    for k in range(count):
        known[k], now[k] = next(streams[k], (-1, b""))
    tree = [-1] * count
    total = sum(len(r.prefix) for r in runs)
    order, prefixes = np.empty(total, np.int32), np.empty(total, np.uint8)

    def played(c: int, node: int) -> int:
        """Run c goes up from a node; losers stay behind."""
        while node:
            other = tree[node]
            a, b = known[c], known[other]
            if a == b and a >= 0:
                x, y = now[c], now[other]
                n = min(len(x), len(y))
                differ = int.from_bytes(x[a:n], "big") ^ int.from_bytes(y[a:n], "big")
                same = n - (differ.bit_length() + 7) // 8
                if same == n:
                    first = len(x) < len(y) or len(x) == len(y) and c < other
                else:
                    first = x[same] < y[same]
                if first:
                    known[other] = same
                else:
                    known[c] = same
                    tree[node], c = c, other
            elif a < b:
                tree[node], c = c, other
            node >>= 1
        return c

    # First round: each run climbs until it meets an empty node, and waits there for a rival.
    winner = -1
    for k in range(count):
        c, node = k, (k + count) >> 1
        while node:
            if tree[node] < 0:
                tree[node] = c
                c = -1
                break
            a, b = c, tree[node]
            x, y = now[a], now[b]
            if known[a] < 0 or known[b] < 0:
                first = known[a] >= known[b]
            else:
                n = min(len(x), len(y))
                differ = int.from_bytes(x[:n], "big") ^ int.from_bytes(y[:n], "big")
                same = n - (differ.bit_length() + 7) // 8
                first = (x, a) < (y, b)
                known[b if first else a] = same
            if not first:
                tree[node], c = a, b
            node >>= 1
        if c >= 0:
            winner = c
    for k in range(total):
        order[k], prefixes[k] = winner, known[winner]
        known[winner], now[winner] = next(streams[winner], (-1, b""))
        winner = played(winner, (winner + count) >> 1)
    return order, prefixes


def repeated(prefix: np.ndarray, right_size: np.ndarray, left: np.ndarray, left_size: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """(suffixes, HALF): whether the string that begins so many bytes before a suffix starts earlier
    as well. `rank` is the order of the suffixes' places in the corpus."""
    out = np.zeros((len(prefix), HALF), bool)
    deep = np.cumsum(prefix < CORE)
    alone = np.bincount(deep, minlength=deep[-1] + 1)[deep] < 2
    at = np.flatnonzero(~alone)
    at = at[np.argsort(rank[at], kind="stable")]
    before = np.zeros(len(at), np.uint64)
    for offset in range(HALF):
        if offset:  # one byte more on the left
            before = mix(before * np.uint64(257) + left[at, HALF - offset] + np.uint64(1))
        fits = (LENGTH - right_size[at] <= offset) & (left_size[at] >= offset)
        node = np.cumsum(prefix < LENGTH - offset)[at]
        key = mix(before + node.astype(np.uint64) * np.uint64(MULTIPLIER))[fits]
        order = np.argsort(key, kind="stable")
        later = np.concatenate([[False], key[order][1:] == key[order][:-1]])[: len(key)]
        out[at[fits][order[later]], offset] = True
    return out


# --- On Spark ------------------------------------------------------------------------------------


def numbered(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in corpus order: their numbers, doc ids and places (a later row of the same id counts from
    further on). Of rows of one id, texts go in the order of their bytes."""
    doc = table.column("doc").to_numpy()
    order = np.argsort(doc, kind="stable")
    twin = np.concatenate([[False], doc[order][1:] == doc[order][:-1]])
    if twin.any():
        texts = table.column("text")
        tied = twin | np.concatenate([twin[1:], [False]])
        own = order[tied]
        order[tied] = sorted(own.tolist(), key=lambda k: (doc[k], texts[k].as_py().encode()))
    ids = doc[order]
    first = np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1]) if len(ids) else np.zeros(0, int)
    turn = np.arange(len(ids)) - np.repeat(first, np.diff(np.concatenate([first, [len(ids)]])))
    return order, ids, turn.astype(np.int64) << PLACE_BITS


def texts_of(table: pa.Table, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return text_bytes(table.column("text").take(pa.array(order)))


def base_of(docs: DataFrame, buckets: int, carry: list[str]) -> DataFrame:
    doc = F.coalesce(F.col("doc_id"), F.lit(NO_ID))
    bucket = F.pmod(F.xxhash64(doc), F.lit(buckets)).cast("int")
    more = [F.col(f"`{c}`").alias(f"carry_{k}") for k, c in enumerate(carry)]
    return docs.select(bucket.alias("bucket"), doc.alias("doc"), F.coalesce("text", F.lit("")).alias("text"), *more)


def seen_twice(base: DataFrame) -> DataFrame:
    """(bucket, packed): hashes of suffix cores that occur more than once, for each bucket they occur in."""

    def cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            bucket = batch.column(0).to_numpy()
            for a, b in spans(offsets, 1 << 18):
                part, bounds = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                chosen = suffixes(part, bounds)
                owner = np.searchsorted(bounds, chosen.start, side="right") - 1
                found = packed(chosen.core, bucket[a:b][owner].astype(np.uint64))
                once, often = np.unique(found, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([once, once[often > 1]]))], ["packed"])

    def twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Sorted by hash, then bucket: a hash that has a row like it before or after it stays.
        for table in sorted_groups(batches, 1, 1 << 17):
            value = table.column("packed").to_numpy()
            core = value >> BUCKET_BITS
            like = np.zeros(len(core), bool)
            like[1:] = core[1:] == core[:-1]
            like[:-1] |= core[1:] == core[:-1]
            kept = np.unique(value[like])
            bucket = (kept & ((1 << BUCKET_BITS) - 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(kept)], ["bucket", "packed"])

    rows = base.select("bucket", "text").mapInArrow(lean(cores), "packed long")
    rows = rows.select(F.shiftright("packed", BUCKET_BITS).alias("core"), "packed")
    rows = rows.repartition("core").sortWithinPartitions("core", "packed")
    return rows.mapInArrow(lean(twice), "bucket int, packed long")


def borders(base: DataFrame, ranges: int, total: int, sample: int = 2000) -> list[bytes]:
    """Where ranges of suffixes begin, from those of about `sample` of `total` texts. They only
    decide how evenly the work is dealt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[bytes] = []
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for a, b in spans(offsets, 1 << 18):
                part = data[offsets[a] : offsets[b]]
                start = suffixes(part, offsets[a : b + 1] - offsets[a]).start
                found += [part[s : s + CORE].tobytes() for s in start.tolist()]
        found = sorted(set(found))
        chosen = sorted({found[len(found) * k // ranges] for k in range(1, ranges)}) if found else []
        yield pa.RecordBatch.from_arrays([pa.array(chosen, pa.binary())], ["border"])

    some = about(base, "doc", sample, total).select("text").repartition(1)
    return sorted(bytes(r["border"]) for r in some.mapInArrow(lean(run), "border binary").collect())


PARCEL = "target long, bucket int, payload binary"


def spans_payload(doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> bytes:
    import zstandard

    out = io.BytesIO()
    np.save(out, np.stack([doc, begin, end]).astype(np.int64))
    return zstandard.ZstdCompressor(level=1).compress(out.getvalue())


def runs_of(base: DataFrame, repeats: DataFrame, cuts: list[bytes]) -> DataFrame:
    """Parcels: sorted front-coded runs for a range (target from 0 on), and for a bucket (target
    below 0) the spans of its own suffixes whose context it holds twice: all but the first go."""
    limits = np.array([c.ljust(CORE, b"\0") for c in cuts], f"S{CORE}")

    def run(key: tuple, texts: pa.Table, known: pa.Table) -> pa.Table:
        bucket = int((texts if len(texts) else known).column("bucket")[0].as_py())
        wanted = np.sort(known.column("packed").to_numpy()) if len(known) else np.zeros(0, np.int64)
        out: list[tuple[int, int, bytes]] = []
        if len(texts) and len(wanted):
            order, ids, place = numbered(texts)
            data, offsets = texts_of(texts, order)
            held: list[tuple] = []
            for a, b in spans(offsets, 1 << 18):
                part, bounds = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                found = suffixes(part, bounds)
                code = packed(found.core, np.full(len(found.core), bucket, np.uint64))
                at = np.searchsorted(wanted, code)
                hit = wanted[np.minimum(at, len(wanted) - 1)] == code
                found = Suffixes(*(x[hit] for x in found))
                owner = np.searchsorted(bounds, found.start, side="right") - 1
                right, left = contexts(part, found)
                where = place[a:b][owner] + found.start - bounds[owner]
                held.append((right, left, LENGTH - found.low, found.high, ids[a:b][owner], where))
            right, left, right_size, left_size, doc, where = (np.concatenate(x) for x in zip(*held, strict=True))
            del data, held
            key_of = np.concatenate([right, right_size[:, None].astype(np.uint8), left, left_size[:, None].astype(np.uint8)], axis=1)
            key_of = np.ascontiguousarray(key_of).view(f"S{key_of.shape[1]}").ravel()
            sort = np.argsort(key_of, kind="stable")  # the first of equal contexts is the earliest
            key_of = key_of[sort]
            new = np.concatenate([[True], key_of[1:] != key_of[:-1]])[: len(sort)]
            again = sort[~new]
            if len(again):
                begin = where[again] - left_size[again]
                out.append((-1 - bucket, bucket, spans_payload(doc[again], begin, where[again] + right_size[again])))
            kept = sort[new]
            heads = np.ascontiguousarray(right[kept][:, :CORE]).view(f"S{CORE}").ravel()
            target = np.searchsorted(limits, heads, side="right")
            edges = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1], [True]])) if len(kept) else []
            for a, b in zip(edges, edges[1:], strict=False):
                k = kept[a:b]
                part = Run(right[k], left[k], right_size[k], left_size[k], doc[k], where[k])
                out.append((int(target[a]), bucket, dump(part)))
        kinds = [pa.int64(), pa.int32(), pa.binary()]
        trim()
        columns = list(zip(*out, strict=True)) if out else [(), (), ()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["target", "bucket", "payload"])

    return base.groupBy("bucket").cogroup(repeats.groupBy("bucket")).applyInArrow(run, PARCEL)


def resolved(parcels: DataFrame) -> DataFrame:
    """(bucket, payload): spans to remove, from the merged runs of each range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches, 1, 1):
            target = table.column("target").to_numpy()
            bucket = table.column("bucket").to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1], [True]]))
            for a, b in zip(edges, edges[1:], strict=False):
                if target[a] < 0:
                    yield from table.slice(a, b - a).select(["bucket", "payload"]).combine_chunks().to_batches()
                    continue
                runs = [undump(p.as_py()) for p in table.column("payload").slice(a, b - a)]
                order, prefix = merged(runs)
                sort = np.argsort(order, kind="stable")  # places of each run's suffixes, run by run
                turn = np.empty(len(order), np.int64)
                turn[sort] = np.arange(len(order))

                def column(name: str, runs=runs, turn=turn) -> np.ndarray:
                    return np.concatenate([getattr(r, name) for r in runs])[turn]

                doc, place = column("doc"), column("place")
                rank = np.empty(len(order), np.int64)
                rank[np.lexsort((place, doc))] = np.arange(len(order))
                left_size = column("left_size").astype(np.int64)
                right_size = column("right_size").astype(np.int64)
                found = repeated(prefix.astype(np.int64), right_size, column("left"), left_size, rank)
                # Neighbouring strings of a suffix that are all repeated make one span.
                edge = np.zeros((len(found), HALF + 2), np.int8)
                edge[:, 1:-1] = found
                step = np.diff(edge, axis=1)
                who, first = np.nonzero(step == 1)
                last = np.nonzero(step == -1)[1] - 1
                home = bucket[a:b][order[who]]
                for k in np.unique(home):
                    own = home == k
                    w = who[own]
                    raw = spans_payload(doc[w], place[w] - last[own], place[w] - first[own] + LENGTH)
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([raw], pa.binary())], ["bucket", "payload"])

    return parcels.repartition("target").sortWithinPartitions("target", "bucket").mapInArrow(lean(run), "bucket int, payload binary")


def deduplicate(
    docs: DataFrame, kept: str | None = "binary", carry: list[str] | None = None, bucket_bytes: int = 8 << 20
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 and `kept`, what is
    left, for every row of `docs` (doc_id, text); then the columns of `carry`, as they came. `kept` is
    binary, or string (a character that lost a byte is left out), or None for no such column.

    Texts are their UTF-8 bytes, NULL is empty. Strings are judged on the input, overlaps count. A
    row without id comes after all others; of rows that repeat an id, the one whose text has the
    smaller bytes comes first. Texts of fewer than 100 bytes lose nothing.
    """
    carry = carry or []
    size = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    buckets = int(min(max(-(-(size["bytes"] or 0) // bucket_bytes), 8), (1 << BUCKET_BITS) - 1))
    base = base_of(docs, buckets, carry)
    dealt = base.repartition("bucket")
    parcels = runs_of(dealt, seen_twice(base), borders(base, buckets, size["rows"]))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if kept else [])]
    types = [pa.int64()] * 4 + [pa.string(), pa.string() if kept == "string" else pa.binary()]
    more = dealt.schema.fields[3:]

    def finish(key: tuple, texts: pa.Table, found: pa.Table) -> pa.Table:
        import zstandard

        rows: list[tuple] = []
        order, ids, place = numbered(texts)
        if len(ids):
            data, offsets = texts_of(texts, order)
            press = zstandard.ZstdDecompressor()
            parts = [np.load(io.BytesIO(press.decompress(p.as_py()))) for p in found.column("payload")]
            doc, begin, end = np.concatenate(parts, axis=1) if parts else np.zeros((3, 0), np.int64)
            owner = np.searchsorted(ids, doc) + (begin >> PLACE_BITS)
            shift = offsets[:-1][owner] - place[owner]
            change = np.zeros(len(data) + 1, np.int32)
            np.add.at(change, begin + shift, 1)
            np.add.at(change, end + shift, -1)
            gone = np.cumsum(change)[: len(data)] > 0
            for k in range(len(ids)):
                a, b = offsets[k], offsets[k + 1]
                mask = gone[a:b]
                left = data[a:b][~mask].tobytes()
                starts = int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum())
                name = None if ids[k] == NO_ID else int(ids[k])
                digest = hashlib.sha256(left).hexdigest()
                rest = left.decode(errors="ignore") if kept == "string" else left
                rows.append((name, int(b - a), int(mask.sum()), starts, digest, rest))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 6
        made = [pa.array(columns[k], types[k]) for k in range(len(names))]
        trim()
        taken = [texts.column(f.name).take(pa.array(order)) for f in more]
        return pa.table([*made, *taken], names=[*names, *[f.name for f in more]])

    shape = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    shape += f", kept {kept}" if kept else ""
    whole = docs.sparkSession.createDataFrame([], shape).schema
    for f in more:
        whole = whole.add(f)
    out = dealt.groupBy("bucket").cogroup(resolved(parcels).groupBy("bucket")).applyInArrow(finish, whole)
    return out.select(*names, *[F.col(f.name).alias(c) for f, c in zip(more, carry, strict=True)])


def strip(docs: DataFrame) -> DataFrame:
    """The rows of `docs` with repeated bytes taken out of `text` (a character that loses a byte goes
    whole) and `n_chars` counted anew, in the columns they came with."""
    carry = [c for c in docs.columns if c not in ("doc_id", "text")]
    found = deduplicate(docs, "string", carry).withColumnRenamed("kept", "text")
    if "n_chars" in carry:
        found = found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return found.select(*docs.columns)
