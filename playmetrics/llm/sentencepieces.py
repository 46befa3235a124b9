"""SentencePiece encoding and decoding; giant documents by a max-plus parallel scan.

A text is a path of pieces, and every step from one piece to the next has a weight: for a unigram
model the score of the new piece; for a BPE model 0 where merging the two pieces' characters gives
back just these two, and minus infinity elsewhere, since a sequence is the BPE encoding exactly if
all its neighbours stand that test. A document longer than a chunk is cut anywhere. The state at a
cut is the piece that ends there or reaches over it; each chunk yields the matrix of best weights
from the states at its begin to those at its end, matrices are combined by the (associative)
max-plus product, and with the states at its two cuts known each chunk is traced back alone.

No piece holds a space after another character. So the first space after a character in a chunk
forgets the state at its begin, and all words between the first and the last are the same for
every state.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from playmetrics.operators.sizing import settle_table

SPACE = "▁"
CHUNK = 32768
LOW = float("-inf")
State = tuple[int, str]  # characters beyond the cut, piece


class Words(dict):
    """Ids, as little-endian bytes, of the words met so far (their space sign left out): no neighbour
    can change them. Emptied when it is full."""

    def __init__(self, pieces: Pieces, most: int = 250_000) -> None:
        self.pieces, self.most = pieces, most

    def __missing__(self, word: str) -> bytes:
        found = np.array(self.pieces.word(SPACE + word), "<i4").tobytes()
        if len(word) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[word] = found
        return found


class Pieces:
    """A model's pieces. `unigram`: steps weigh the piece's score, otherwise the BPE rule holds.
    `single` encodes one whole word, if there is something faster than the steps for it."""

    def __init__(
        self, ids: dict[str, int], scores: dict[str, float], bytes_: list[int], unknown: int, unigram: bool, single=None
    ) -> None:
        self.ids, self.scores, self.bytes, self.unknown, self.unigram = ids, scores, bytes_, unknown, unigram
        self.single = single
        self.longest = max(map(len, ids), default=1)
        self.pairs: dict[tuple[str, str], float] = {}
        self.words = Words(self)
        self.worst = min(scores.values(), default=0.0) - 10.0

    def merged(self, text: str) -> list[str]:
        """Plain BPE: merge the neighbours that make the best piece, leftmost first, while any do."""
        parts = list(text)
        while True:
            best, at = LOW, -1
            for k in range(len(parts) - 1):
                score = self.scores.get(parts[k] + parts[k + 1], LOW)
                if score > best:
                    best, at = score, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def weight(self, before: str, piece: str) -> float:
        """Of the step to `piece` ('' before the first)."""
        if self.unigram:
            return self.scores.get(piece, self.worst)
        found = self.pairs.get((before, piece))
        if found is None:
            fits = self.merged(before + piece) == ([before, piece] if before else [piece])
            found = 0.0 if fits else LOW
            if len(self.pairs) > 300_000:
                self.pairs.clear()
            self.pairs[before, piece] = found
        return found

    def candidates(self, text: str, end: int, first: int) -> Iterator[str]:
        """Pieces that end at `end` and begin at `first` or later; a lone character always can."""
        for begin in range(end - 1, max(first, end - self.longest) - 1, -1):
            if begin == end - 1 or text[begin:end] in self.ids:
                yield text[begin:end]

    def advance(self, text: str, state: State, stop: int) -> list[tuple[float, str] | None]:
        """For each position up to `stop` the best weight of a path from the state, and its last piece."""
        begin, piece = state
        best: list[tuple[float, str] | None] = [None] * (stop + 1)
        if begin <= stop:
            best[begin] = (0.0, piece)
        for end in range(begin + 1, stop + 1):
            top = None
            for t in self.candidates(text, end, begin):
                was = best[end - len(t)]
                if was is not None:
                    value = was[0] + self.weight(was[1], t)
                    if value > LOW and (top is None or value > top[0]):
                        top = (value, t)
            best[end] = top
        return best

    def ids_of(self, piece: str) -> tuple[int, ...]:
        found = self.ids.get(piece)
        if found is not None:
            return (found,)
        return tuple(self.bytes[b] for b in piece.encode()) if self.bytes else (self.unknown,)

    def traced(self, best: list[tuple[float, str] | None], end: int, begin: int) -> list[str]:
        out = []
        while end > begin:
            piece = best[end][1]
            out.append(piece)
            end -= len(piece)
        return out[::-1]

    def word(self, text: str) -> list[int]:
        """Ids of a run of spaces and the characters after it."""
        if self.single is not None and len(text) > 1:
            return self.single(text[1:].replace(SPACE, " "))
        best = self.advance(text, (0, ""), len(text))
        return [i for p in self.traced(best, len(text), 0) for i in self.ids_of(p)]

    def run(self, text: str) -> bytes:
        """Ids of whole words, each with its spaces in front, as little-endian bytes."""
        if not text:
            return b""
        if text[0] == SPACE and 2 * SPACE not in text and text[-1] != SPACE:
            return b"".join(map(self.words.__getitem__, text[1:].split(SPACE)))
        return b"".join(np.array(self.word(w), "<i4").tobytes() for w in words(text))


@lru_cache(maxsize=4)
def load(path: str) -> Pieces:
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    processor = sentencepiece.SentencePieceProcessor(model_file=path)
    model.ParseFromString(processor.serialized_model_proto())
    ids, scores, bytes_ = {}, {}, {}
    for k, p in enumerate(model.pieces):
        if p.type == 1:  # ordinary pieces: not control, unknown or byte ones
            ids[p.piece], scores[p.piece] = k, p.score
        elif p.type == 6:
            bytes_[int(p.piece[3:5], 16)] = k
    unknown = processor.unk_id()
    known = [bytes_[b] for b in range(256)] if len(bytes_) == 256 else []
    return Pieces(ids, scores, known, unknown, model.trainer_spec.model_type == 1, processor.encode)


def normal(text: str) -> str:
    """As the model reads it: a space in front, and spaces as a visible sign. '' stays ''."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def words(text: str) -> Iterator[str]:
    """Runs of spaces with what follows them."""
    at = 0
    while at < len(text):
        to = at
        while to < len(text) and text[to] == SPACE:
            to += 1
        to = text.find(SPACE, to)
        to = len(text) if to < 0 else to
        yield text[at:to]
        at = to


def encode_whole(pieces: Pieces, text: str) -> np.ndarray:
    return np.frombuffer(pieces.run(normal(text)), "<i4")


# --- One chunk: text[begin:end] of a normalised text, with what stands around it ------------------


def first_cut(text: str, begin: int, end: int) -> int:
    """The first place from `begin` where a space follows another character, or -1."""
    at = text.find(SPACE, max(begin, 1), end)
    while at > 0 and text[at - 1] == SPACE:
        at = text.find(SPACE, at + 1, end)
    return at if at > 0 else -1


def last_cut(text: str, begin: int, end: int) -> int:
    at = text.rfind(SPACE, begin, end)
    while at > 0 and text[at - 1] == SPACE and at > begin:
        at = text.rfind(SPACE, begin, at)
    return at if at > 0 and text[at - 1] != SPACE else -1


def states_at(pieces: Pieces, text: str, cut: int) -> list[State]:
    """All pieces that end at the cut or reach over it and could stand in an encoding: those on a
    path from the word's begin, if that can be seen from here and decides (BPE paths are unique)."""
    if cut <= 0:
        return [(0, "")]
    word = last_cut(text, 0, cut)
    if word > 0 and not pieces.unigram:
        best = pieces.advance(text[word:cut], (0, ""), cut - word)
        return list(exits(pieces, text, best, word, cut, False))
    out = []
    for begin in range(max(0, cut - pieces.longest), cut):
        for end in range(cut, min(len(text), begin + pieces.longest) + 1):
            piece = text[begin:end]
            if (len(piece) == 1 or piece in pieces.ids) and pieces.weight("", piece) > LOW:
                out.append((end - cut, piece))
    return out


def exits(pieces: Pieces, text: str, best: list, base: int, end: int, final: bool) -> dict[State, float]:
    """Best weight of each state at `end`; best[k] is for position base + k."""
    out: dict[State, float] = {}
    for k, was in enumerate(best):
        if was is None or base + k > end:
            continue
        if base + k == end:
            out[0, was[1]] = max(was[0], out.get((0, was[1]), LOW))
            continue
        for to in range(end + 1, min(len(text), base + k + pieces.longest) + 1) if not final else ():
            piece = text[base + k : to]
            if piece in pieces.ids and (value := was[0] + pieces.weight(was[1], piece)) > LOW:
                out[to - end, piece] = max(value, out.get((to - end, piece), LOW))
    return out


def transfer(pieces: Pieces, text: str, begin: int, end: int, final: bool) -> list[tuple[State, State, float]]:
    """The chunk's matrix as its finite entries (state at begin, state at end, weight)."""
    before = states_at(pieces, text, begin)
    head, tail = first_cut(text, begin, end), last_cut(text, begin, end)
    out: list[tuple[State, State, float]] = []
    if head < 0:  # no word ends here: every state goes its own way through the whole chunk
        for state in before:
            best = pieces.advance(text[begin:], state, max(end - begin, state[0]))
            if state[0] > end - begin:
                out.append((state, (state[0] - (end - begin), state[1]), 0.0))
            else:
                out += [(state, x, v) for x, v in exits(pieces, text, best, begin, end, final).items()]
        return out
    middle = 0.0
    if pieces.unigram and tail > head:
        middle = pieces.advance(text[head:tail], (0, ""), tail - head)[-1][0]
    best = pieces.advance(text[tail:end], (0, ""), end - tail)
    after = exits(pieces, text, best, tail, end, final)
    for state in before:
        if state[0] <= head - begin:
            reached = pieces.advance(text[begin:head], state, head - begin)[-1]
            if reached is not None:
                out += [(state, x, reached[0] + middle + v) for x, v in after.items()]
    return out


def product(a: dict, b: dict) -> dict:
    """Max-plus product of two matrices given as {state: {state: weight}}."""
    out: dict = {}
    for i, row in a.items():
        into = out.setdefault(i, {})
        for j, v in row.items():
            for k, w in b.get(j, {}).items():
                if v + w > into.get(k, LOW):
                    into[k] = v + w
    return out


def scanned(matrices: list[dict]) -> list[dict]:
    """Products of the first 1, 2, ... matrices, by pairs: the scan that associativity allows."""
    if len(matrices) == 1:
        return matrices
    halves = scanned([product(a, b) for a, b in zip(matrices[::2], matrices[1::2], strict=False)])
    out = [matrices[0]]
    for k in range(1, len(matrices)):
        out.append(halves[k // 2] if k % 2 else product(halves[k // 2 - 1], matrices[k]))
    return out


def path(matrices: list[dict]) -> list[State]:
    """The states at all cuts, first and last included, on the best path."""
    reach = [row.get((0, ""), {}) for row in scanned(matrices)]
    now = max(((v, s) for s, v in reach[-1].items() if s[0] == 0), default=(0.0, (0, "")))[1]
    out = [now]
    for k in range(len(matrices) - 1, 0, -1):
        options = [(v + matrices[k][s][now], s) for s, v in reach[k - 1].items() if now in matrices[k].get(s, {})]
        now = max(options)[1]
        out.append(now)
    return [(0, ""), *out[::-1]]


def trace(pieces: Pieces, text: str, begin: int, end: int, entry: State, leave: State) -> np.ndarray:
    """Ids of the pieces that begin within the chunk, between the states at its cuts."""
    start, stop = begin + entry[0], end + leave[0] - len(leave[1])
    none = np.zeros(0, "<i4")
    if start > end or entry[0] > end - begin:
        return none
    reach = stop if leave[1] else end
    head, tail = first_cut(text, begin, end), last_cut(text, begin, end)
    if reach < start:  # one piece covers the whole chunk
        return none
    if head < 0 or head < start:
        best = pieces.advance(text[begin:], entry, reach - begin)
        steps, middle = [pieces.traced(best, reach - begin, entry[0]), []], b""
    else:
        best = pieces.advance(text[begin:head], entry, head - begin)
        steps, middle = [pieces.traced(best, head - begin, entry[0])], pieces.run(text[head:tail])
        best = pieces.advance(text[tail:reach], (0, ""), reach - tail)
        steps.append(pieces.traced(best, reach - tail, 0))
    first, last = ([i for p in step for i in pieces.ids_of(p)] for step in steps)
    last += pieces.ids_of(leave[1]) if leave[1] else ()
    return np.concatenate([np.array(first, "<i4"), np.frombuffer(middle, "<i4"), np.array(last, "<i4")])


# --- On Spark ------------------------------------------------------------------------------------


def cut(giants: DataFrame, chunk: int, around: int) -> DataFrame:
    """Chunks of the normalised text: key, chunk, chunks, and the text with `around` characters on
    both sides, of which the chunk is [begin, end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                whole = normal(text)
                count, rows = -(-len(whole) // chunk), []
                for k in range(count):
                    a, b = k * chunk, min(len(whole), (k + 1) * chunk)
                    left = max(0, a - around)
                    rows.append((key, k, count, whole[left : b + around], a - left, b - left))
                    if len(rows) == 64 or k == count - 1:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["key", "chunk", "chunks", "text", "begin", "end"])
                        rows = []

    return giants.select("key", "text").mapInArrow(run, "key string, chunk long, chunks long, text string, begin long, end long")


def encode(docs: DataFrame, model: str, chunk: int = CHUNK) -> DataFrame:
    """doc_id, text, n_chunks and ids (array of int) for every row of `docs`.

    `model` is the path of a model file that every executor has. NULL texts have NULL ids, empty ones
    none. Rows that repeat id and text are encoded alike. Texts of more than `chunk` characters go
    through the scan; a document's matrices (some states at each cut) meet in one task, its text
    doesn't until its ids are put together.
    """
    rows = docs.select("doc_id", "text")
    long = F.length("text") >= chunk

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(1).to_pylist()
                found = [None if t is None else encode_whole(pieces, t) for t in texts]
                ends = np.cumsum([0] + [0 if x is None else len(x) for x in found]).astype(np.int32)
                values = np.concatenate([np.zeros(0, np.int32), *[x for x in found if x is not None]])
                mask = pa.array([x is None for x in found], pa.bool_())
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(values), mask=mask)
                chunks = pa.array([None if x is None else 1 for x in found], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), chunks, ids], ["doc_id", "text", "n_chunks", "ids"])

    shape = "doc_id long, text string, n_chunks long, ids array<int>"
    short = rows.filter(~F.coalesce(long, F.lit(False))).mapInArrow(whole, shape)
    giants = rows.filter(long).withColumn("key", F.sha2("text", 256))
    around = 24 if model is None else 2 * load(model).longest
    chunks = cut(giants, chunk, around).dropDuplicates(["key", "chunk"])
    chunks = settle_table(chunks.repartition("key", "chunk"), "chunks")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for batch in batches:
            out = []
            for key, k, count, text, begin, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out.append((key, k, json.dumps(transfer(pieces, text, begin, end, k == count - 1))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["key", "chunk", "entries"])

    def combine(key: tuple, table: pa.Table) -> pa.Table:
        found = sorted(zip(table["chunk"].to_pylist(), table["entries"].to_pylist(), strict=True))
        steps = []
        for _, entries in found:
            matrix: dict = {}
            for a, b, v in json.loads(entries):
                matrix.setdefault((a[0], a[1]), {})[b[0], b[1]] = v
            steps.append(matrix)
        at = path(steps)
        rows = [(key[0].as_py(), k, *at[i], *at[i + 1]) for i, (k, _) in enumerate(found)]
        names = ["key", "chunk", "over_in", "piece_in", "over_out", "piece_out"]
        return pa.table([pa.array(c) for c in zip(*rows, strict=True)], names=names)

    states = chunks.mapInArrow(matrices, "key string, chunk long, entries string").groupBy("key")
    states = states.applyInArrow(combine, "key string, chunk long, over_in long, piece_in string, over_out long, piece_out string")

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                entry, leave = (row["over_in"], row["piece_in"]), (row["over_out"], row["piece_out"])
                ids = trace(pieces, row["text"], row["begin"], row["end"], entry, leave)
                out.append((row["key"], row["chunk"], ids))
            if out:
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2], pa.list_(pa.int32()))], ["key", "chunk", "ids"])

    traced = chunks.join(states, ["key", "chunk"]).mapInArrow(back, "key string, chunk long, ids array<int>")
    parts = F.sort_array(F.collect_list(F.struct("chunk", "ids")))
    texts = traced.groupBy("key").agg(parts.alias("parts"))
    texts = texts.select("key", F.size("parts").cast("long").alias("n_chunks"), F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))
    return short.unionByName(giants.join(texts, "key").select("doc_id", "text", "n_chunks", "ids"))


def decode(rows: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """The rows with `decoded`, the text their ids stand for (NULL for NULL), and `ids_crc32`, the
    checksum of the ids as little-endian unsigned 32-bit numbers. Bytes that are no UTF-8 become the
    replacement character; ids outside the model fail."""
    names = [c for c in rows.columns if c not in ("decoded", "ids_crc32")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        table = {i: p.replace(SPACE, " ").encode() for p, i in pieces.ids.items()}
        table |= {i: bytes([b]) for b, i in enumerate(pieces.bytes)} | ({} if pieces.bytes else {pieces.unknown: " ⁇ ".encode()})
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch, texts, sums = whole.slice(at, 1000), [], []
                for row in batch.column(batch.schema.get_field_index(ids)):
                    values = None if row.values is None else row.values.to_numpy()
                    if values is None:
                        texts.append(None)
                        sums.append(None)
                        continue
                    raw = b"".join(map(table.__getitem__, values.tolist()))
                    texts.append(raw[1 if raw[:1] == b" " else 0 :].decode(errors="replace"))
                    sums.append(zlib.crc32(values.astype("<u4").tobytes()))
                made = [pa.array(texts, pa.string()), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*names, "decoded", "ids_crc32"])

    kept = rows.select(*names)
    shape = StructType([*kept.schema.fields, StructField("decoded", StringType()), StructField("ids_crc32", LongType())])
    return kept.mapInArrow(run, shape)
