"""Alignment of two tokenizers' tokens over a corpus, each distinct text once.

The rows are shuffled by their full text, so all copies of a text become one row with a count, and
that row alone is tokenised and aligned. What the corpus says of a pair of token ids is the sum of
those counts over the distinct texts that hold the pair linked. The measures of a text are joined to
the doc_ids of its copies in the end.

Inside a text, both tokenizers are sure to start a token at a single space between two visible
characters: the byte-level one splits there before it merges, and no piece of the other one holds the
mark of a space after another character. Both are checked against the files; a pair of tokenizers of
which it does not hold gets whole texts. So a text is a sequence of words that are tokenised by
themselves, and the ids of recent words are kept per worker. Very long texts are worked through in
segments of words.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playmetrics.llm.common import lean
from playmetrics.operators.sizing import attach, settle_table, small_enough

# A single space between two visible characters.
CUT = re.compile(r"(?= [!-~\w])(?<=[!-~\w])")
# A space beside other white space or at the end.
ODD_SPACE = re.compile(r"\s | \s| \Z")
SEGMENT = 1 << 18
BATCH_CHARS = 1 << 20
KEPT_WORDS, KEPT_CHARS = 200_000, 1 << 23
# Merging longer words is left to the library whose time does not grow with their square.
LONG_WORD = 400
# The table of pair counts is looked up in memory up to this measured size, and joined beyond it.
TABLE_BYTES = 32 * 1024 * 1024
PARTIAL_PAIRS = 1 << 20
SPACE_MARK = "▁"

# Fixed value: how byte-level BPE splits a text before it merges.
SPLITS = (
    r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
)

MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


# What a word adds to its text: its number of A tokens; of each link the A id times the size of
# vocabulary B, plus the B id; its groups.
Word = tuple[int, bytes, str]
ABSENT = (-1, b"", "")


def byte_table() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte: visible Latin-1 characters stand
    for themselves, the others for the code points from 256 on, in order."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(others)}


class Total:
    """The measures of a text, summed over its segments of words."""

    def __init__(self, keep: bool) -> None:
        self.n_a = self.n_groups = 0
        self.whole, self.digest = True, hashlib.sha256()
        self.kept: list[str] | None = [] if keep else None
        self.pairs: list[np.ndarray] = []
        self.links: list[np.ndarray] = []

    def add(self, words: list[Word | None]) -> None:
        if not self.whole or None in words:
            self.whole = False
            return
        n_a, pairs, groups = zip(*words, strict=True)
        ids, counts = np.unique(np.frombuffer(b"".join(pairs), "<u8"), return_counts=True)
        self.pairs.append(ids)
        self.links.append(counts)
        text = ";".join(groups)
        self.digest.update(b";" * (self.n_groups > 0) + text.encode())
        self.n_a += sum(n_a)
        self.n_groups += text.count(";") + 1
        if self.kept is not None:
            self.kept.append(text)

    def result(self) -> dict | None:
        """None if a tokenizer did not give the bytes back."""
        if not self.whole:
            return None
        ids, counts = self.pairs[0], self.links[0]
        if len(self.pairs) > 1:
            ids, at = np.unique(np.concatenate(self.pairs), return_inverse=True)
            counts = np.bincount(at, np.concatenate(self.links)).astype(np.int64)
        n_links = int(counts.sum())
        # Each stretch between two ends is a link, and each group's last end is one of both sides.
        return {
            "n_a": self.n_a, "n_b": n_links + self.n_groups - self.n_a, "n_groups": self.n_groups, "n_links": n_links,
            "groups_sha256": self.digest.hexdigest(), "pairs": ids, "links": counts,
            "groups": None if self.kept is None else ";".join(self.kept),
        }


class Aligner:
    """Both tokenizers, the bytes of their tokens, and the words aligned lately."""

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        table = byte_table()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            known = all(c in table for c in token)
            a_bytes[i] = bytes(table[c] for c in token) if known else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE_MARK, " ").encode()
            for i, p in enumerate(pieces)
        ]
        self.base = len(pieces)
        # Tokens of A, then those of B: their bytes, and their numbers with each sign that may follow.
        self.bytes = a_bytes + b_bytes
        self.lengths = np.array([len(x) for x in self.bytes])
        self.first_b = len(a_bytes)
        names = [str(i) for i in range(len(a_bytes))] + [str(i) for i in range(len(b_bytes))]
        self.signed = [n + sign for sign in ",|;" for n in names]

        form = json.loads(self.a.to_str())
        splits = form["pre_tokenizer"] or {}
        plain = (
            not form["normalizer"]
            and splits.get("type") == "ByteLevel"
            and splits.get("use_regex", True)
            and not splits["add_prefix_space"]
        )
        self.cuts = plain and not any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces)
        self.quick = self.by_ranks(form, vocabulary, a_bytes) if plain else None
        self.signed_lengths = np.array([len(x) for x in self.signed])
        self.words: dict[str, Word | None] = {}
        self.earlier: dict[str, Word | None] = {}
        self.chars = 0

    def by_ranks(self, form: dict, vocabulary: dict[str, int], a_bytes: list[bytes]):
        """The same vocabulary in a quicker library, which needs ids in the order of the merges."""
        import tiktoken

        added = {t["content"] for t in form["added_tokens"]}
        merges = [m.split(" ") if isinstance(m, str) else m for m in form["model"]["merges"]]
        made = [vocabulary["".join(m)] for m in merges]
        if made != list(range(256, 256 + len(made))) or form["model"].get("ignore_merges"):
            return None
        ranks = {a_bytes[i]: i for t, i in vocabulary.items() if t not in added}
        return tiktoken.Encoding("quick", pat_str=SPLITS, mergeable_ranks=ranks, special_tokens={})

    def aligned(self, words: list[str]) -> list[Word | None]:
        """Words aligned as one text, then cut apart where they end. A word that a tokenizer does not give
        back is None; with such a word among them, or one that its neighbours may change, each is
        taken by itself."""
        text = " " + " ".join(words)
        alone = len(words) == 1
        if not alone and (not self.cuts or ODD_SPACE.search(text)):
            return [x for w in words for x in self.aligned([w])]
        if self.quick is not None and (not alone or len(text) <= LONG_WORD):
            ids = self.quick.encode_ordinary(text)
        else:
            ids = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids
        a, b = np.array(ids, np.int64), np.array(self.b.encode(text[1:]), np.int64)
        both = np.concatenate([a, b + self.first_b])
        raw, tokens = text.encode(), [self.bytes[i] for i in both.tolist()]
        if b"".join(tokens[: len(a)]) != raw or b"".join(tokens[len(a) :]) != raw:
            return [None] if alone else [x for w in words for x in self.aligned([w])]

        # Byte ends of A tokens are marked 1, those of B 2, common ones 3. Each stretch between two
        # marks lies in one token of either side: that is a link.
        widths = self.lengths[both]
        marks = np.zeros(len(raw) + 1, np.uint8)
        marks[np.cumsum(widths[: len(a)])] = 1
        marks[np.cumsum(widths[len(a) :])] += 2
        ends = np.flatnonzero(marks)
        kinds = marks[ends]
        of_a, of_b, closed = kinds & 1, kinds >> 1, kinds == 3
        through_a, through_b = np.cumsum(of_a, dtype=np.int64), np.cumsum(of_b, dtype=np.int64)
        pairs = (a[through_a - of_a] * self.base + b[through_b - of_b]).astype("<u8").tobytes()

        # A group closes at a common end; its A ids come first, then its B ids.
        group = np.cumsum(closed, dtype=np.int64) - closed
        group_a, group_b = group[of_a > 0], group[of_b > 0]
        before_b = np.concatenate([[0], through_b[closed]])
        order = np.empty(len(both), np.int64)
        size = len(self.bytes)
        order[np.arange(len(a)) + before_b[group_a]] = a + size * closed[of_a > 0]
        order[np.arange(len(b)) + through_a[closed][group_b]] = b + self.first_b + 2 * size * closed[of_b > 0]
        groups = "".join(map(self.signed.__getitem__, order.tolist()))

        # Where each word ends: in links, in A tokens, in the characters of the groups.
        links = np.searchsorted(ends, np.cumsum([len(w.encode()) + 1 for w in words])) + 1
        of_words = through_a[links - 1], through_b[links - 1]
        chars = np.cumsum(self.signed_lengths[order])[of_words[0] + of_words[1] - 1]
        out, was = [], (0, 0, 0)
        for here in zip(links.tolist(), of_words[0].tolist(), chars.tolist(), strict=True):
            out.append((here[1] - was[1], pairs[8 * was[0] : 8 * here[0]], groups[was[2] : here[2] - 1]))
            was = here
        return out

    def look_up(self, words: list[str]) -> list[Word | None]:
        """All of these distinct words, from the store or new. The store has two halves; when one is
        full, the older one goes, and words that are met again move on."""
        found = list(map(self.words.get, words, repeat(ABSENT)))
        missing = [w for w, x in zip(words, found, strict=True) if x is ABSENT]
        if not missing:
            return found
        again = list(map(self.earlier.get, missing, repeat(ABSENT)))
        new = [w for w, x in zip(missing, again, strict=True) if x is ABSENT]
        plain = [w for w in new if w and len(w) <= LONG_WORD and " " not in w and w[0] > " " and w[-1] > " "]
        got = dict(zip(missing, again, strict=True))
        got.update(zip(plain, self.aligned(plain) if plain else (), strict=True))
        if len(plain) < len(new):
            got.update((w, self.aligned([w])[0]) for w in set(new).difference(plain))
        self.chars += sum(map(len, new))
        if len(self.words) + len(got) > KEPT_WORDS or self.chars > KEPT_CHARS:
            self.words, self.earlier, self.chars = {}, self.words, 0
        self.words.update(got)
        return [got[w] if x is ABSENT else x for w, x in zip(words, found, strict=True)]

    def segments(self, text: str) -> Iterator[list[str]]:
        """The words of a space and the text, each without the space before it."""
        whole, at = " " + text, 0
        if not self.cuts:
            yield [text]
            return
        while at < len(whole):
            hit = CUT.search(whole, at + SEGMENT) if len(whole) - at > SEGMENT else None
            stop = hit.start() if hit else len(whole)
            piece = whole[at:stop]
            yield [w[1:] for w in CUT.split(piece)] if ODD_SPACE.search(piece) else piece[1:].split(" ")
            at = stop

    def measures(self, texts: list[str], keep: bool) -> list[dict | None]:
        """The measures of each text. Words are looked up for about a million characters at once."""
        totals = [Total(keep) for _ in texts]
        units: list[tuple[Total, list[str]]] = []
        chars = 0
        for total, text in zip(totals, texts, strict=True):
            for words in self.segments(text):
                units.append((total, words))
                chars += min(len(text), SEGMENT)
                if chars > BATCH_CHARS:
                    self.settle(units)
                    units, chars = [], 0
        self.settle(units)
        return [t.result() for t in totals]

    def settle(self, units: list[tuple[Total, list[str]]]) -> None:
        numbers: defaultdict[str, int] = defaultdict()
        numbers.default_factory = numbers.__len__
        at = [list(map(numbers.__getitem__, words)) for _, words in units]
        known = self.look_up(list(numbers))
        for (total, _), places in zip(units, at, strict=True):
            total.add([known[i] for i in places])


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    if (a_path, b_path) not in _ALIGNERS:
        _ALIGNERS[a_path, b_path] = Aligner(a_path, b_path)
    return _ALIGNERS[a_path, b_path]


def pack(pairs: np.ndarray, links: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted pair ids as differences and counts, each in the smallest width that holds them all."""

    def narrow(values: np.ndarray) -> bytes:
        top = int(values.max(initial=0))
        width = next(k for k, bits in ((1, 8), (2, 16), (4, 32), (8, 64)) if top < 1 << bits)
        return bytes([width]) + values.astype(f"<u{width}").tobytes()

    return narrow(np.diff(pairs, prepend=np.uint64(0))), narrow(links)


def unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, f"<u{packed[0]}", offset=1).astype(np.uint64)


def unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs and links of all rows of a batch one after the other, and the row of each."""
    pairs = [np.cumsum(unpack(x)) for x in batch.column("pairs").to_pylist()]
    links = [unpack(x).astype(np.int64) for x in batch.column("links").to_pylist()]
    rows = np.repeat(np.arange(len(pairs)), [len(x) for x in pairs])
    none = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    return np.concatenate(pairs or none[0]), np.concatenate(links or none[1]), rows


def distinct_texts(docs: DataFrame) -> DataFrame:
    """Every distinct text that is not empty, its digest and its number of rows. Copies are counted
    in each task before the shuffle, so a text that a third of all rows hold costs a row per task."""
    texts = docs.select(F.col("text").cast("string").alias("text")).filter("text <> ''")
    counted = texts.groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    return counted.select(F.sha2("text", 256).alias("text_key"), "copies", "text")


def measured(texts: DataFrame, a_path: str, b_path: str, groups: bool) -> DataFrame:
    """The distinct texts without their text but with their counts, packed pairs and groups."""
    fields = [
        ("text_key", pa.string()), ("copies", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()),
        ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()),
        ("pairs", pa.binary()), ("links", pa.binary()), ("groups", pa.string()),
    ]
    schema = pa.schema(fields if groups else fields[:-1])
    kinds = {pa.string(): "string", pa.int64(): "long", pa.binary(): "binary"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(a_path, b_path)
        gc.disable()  # no cycles are made, and walking the store of words takes long
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                given = batch.slice(start, 1000).to_pylist()
                rows = []
                for row, found in zip(given, tool.measures([r["text"] for r in given], groups), strict=True):
                    if found is not None:
                        found["pairs"], found["links"] = pack(found["pairs"], found["links"])
                        rows.append({"text_key": row["text_key"], "copies": row["copies"], **found})
                yield pa.RecordBatch.from_pylist(rows, schema)

    return texts.mapInArrow(lean(run), ", ".join(f"{f.name} {kinds[f.type]}" for f in schema))


def pair_counts(found: DataFrame, base: int) -> DataFrame:
    """Per pair: how many documents hold it linked, and whether that is the most of its A id.

    Tasks add up what they see before the shuffle. The A ids, at most a vocabulary, are broadcast.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                pairs, _, rows = unpacked(batch)
                copies = np.asarray(batch.column("copies"))[rows]
                ids, at = np.unique(np.concatenate([ids, pairs]), return_inverse=True)
                sums = np.zeros(len(ids), np.int64)
                np.add.at(sums, at, np.concatenate([counts, copies]))
                counts = sums
                if len(ids) > PARTIAL_PAIRS:
                    yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(counts)], ["pair", "n"])
                    ids, counts = ids[:0], counts[:0]
        yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(counts)], ["pair", "n"])

    parts = found.select("copies", "pairs", "links").mapInArrow(lean(run), "pair long, n long")
    counts = settle_table(parts.groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    counts = counts.withColumn("a", F.expr(f"pair div {base}"))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    best = counts.join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    return settle_table(best, "counts")


def weighed(found: DataFrame, counts: DataFrame, table_bytes: int) -> DataFrame:
    """Per distinct text: `n_best` and `count_sum` of its links."""
    keys = "text_key string, n_best long, count_sum long"
    if small_enough(counts, table_bytes):
        rows = counts.orderBy("pair").toArrow()
        # The measured bound holds for these three arrays.
        shared = counts.sparkSession.sparkContext.broadcast(
            (np.asarray(rows["pair"]).astype(np.uint64), np.asarray(rows["n"]), np.asarray(rows["best"]))
        )

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, n, best = shared.value
            for whole in batches:
                for start in range(0, whole.num_rows, 1000):
                    batch = whole.slice(start, 1000)
                    pairs, links, rows = unpacked(batch)
                    at = np.searchsorted(ids, pairs)
                    sums = [np.zeros(batch.num_rows, np.int64) for _ in range(2)]
                    np.add.at(sums[0], rows, links * best[at])
                    np.add.at(sums[1], rows, links * n[at])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("text_key"), *map(pa.array, sums)], ["text_key", "n_best", "count_sum"]
                    )

        return found.select("text_key", "pairs", "links").mapInArrow(lean(run), keys)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 100):
                batch = whole.slice(start, 100)
                pairs, links, rows = unpacked(batch)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("text_key").take(pa.array(rows)), pa.array(pairs.astype(np.int64)), pa.array(links)],
                    ["text_key", "pair", "links"],
                )

    # A pair that many texts hold is a skewed key on the larger side, which AQE splits.
    spread_out = found.select("text_key", "pairs", "links").mapInArrow(spread, "text_key string, pair long, links long")
    return spread_out.join(counts, "pair").groupBy("text_key").agg(
        F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"),
        F.sum(F.col("links") * F.col("n")).alias("count_sum"),
    )


def align(
    docs: DataFrame, a_path: str, b_path: str, groups: bool = False, table_bytes: int = TABLE_BYTES
) -> DataFrame:
    """Align the tokens of a byte-level tokenizer file (A) and a SentencePiece model (B) for every row of
    `docs` (doc_id, text).

    Returns one row per input row: doc_id, n_a and n_b (tokens), n_groups (between byte offsets where
    tokens of both end), n_links (overlapping token occurrences), n_best (links whose pair is held by
    most documents among the pairs of its A id, ties included), count_sum (over links, how many
    documents hold the pair), groups_sha256 and, on request, groups (`a1,a2|b1;a3|b2,b3`).

    A NULL or empty text, and a text that one of the tokenizers does not give back byte for byte, has no
    tokens: zeros and empty strings. Special tokens' strings inside a text are plain text. Texts of any length are worked
    through in segments. Repeated rows (and doc_ids) are rows and documents of their own; a NULL doc_id stays NULL. An
    empty table gives no rows. Other columns of `docs`, whatever their names, take no part and are not returned.
    """
    found = settle_table(measured(distinct_texts(docs), a_path, b_path, groups), "aligned")
    base = aligner(a_path, b_path).base
    sums = weighed(found, pair_counts(found, base), table_bytes)
    kept = ["text_key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", *["groups"] * groups]
    side = found.select(*kept).join(sums, "text_key")
    keyed = docs.select("doc_id", F.sha2(F.col("text").cast("string"), 256).alias("text_key"))
    # The copies of one text are a skewed key of the larger side, which AQE splits.
    rows = attach(keyed, side, ["text_key"], broadcast_bytes=TABLE_BYTES // 2)
    return rows.select(
        "doc_id",
        *[F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in MEASURES],
        F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"),
        *[F.coalesce("groups", F.lit("")).alias("groups")] * groups,
    )
