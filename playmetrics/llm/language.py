"""Language ID by a bidirectional gated recurrent network over bytes, trained in numpy.

Both directions read one byte per step; every position gets a label distribution, and a text's is
the mean over its positions. Many segments run side by side, so that a step is a few operations on
arrays of (units, segments).
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from playmetrics.llm.common import held_out, lean, mix, spans, text_bytes
from playmetrics.operators.sizing import attach

UNDETERMINED = "und"


class Settings(NamedTuple):
    """At most `texts` labelled texts per language are learned from, in stretches of `steps` bytes that cover
    them; of a text of more than `stretches` as many are drawn by a hash over all of it. That bounds the
    training's rows, memory and time whatever the table and the texts. What is predicted is read
    whole, in segments of `segment` bytes."""

    texts: int = 400
    stretches: int = 1024
    steps: int = 64
    units: int = 8
    batch: int = 128
    epochs: int = 6
    rate: float = 0.02
    segment: int = 128
    lanes: int = 4096
    seed: int = 17


class Model(NamedTuple):
    """Per direction: input table (3 units x 256, biases within), recurrent matrix, its candidate
    bias; then the output matrix over both directions and its bias. Gates: reset, update, candidate."""

    languages: list[str]
    inputs: list[np.ndarray]
    recurrent: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray


def start(languages: list[str], settings: Settings) -> Model:
    random, units = np.random.default_rng(settings.seed), settings.units
    table = [random.normal(0, 0.3, (3 * units, 256)).astype(np.float32) for _ in range(2)]
    recurrent = [random.normal(0, units**-0.5, (3 * units, units)).astype(np.float32) for _ in range(2)]
    out = random.normal(0, 0.3, (len(languages), 2 * units)).astype(np.float32)
    return Model(languages, table, recurrent, out, np.zeros((len(languages), 1), np.float32))


def sigmoid(x: np.ndarray) -> np.ndarray:
    """In place, through tanh."""
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


def softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(0)
    np.exp(x, out=x)
    x /= x.sum(0)
    return x


def slopes_of(model: Model, x: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """The loss, cross-entropy averaged over all positions of `x` (steps, lanes), and its slope by every
    parameter, by backpropagation through time."""
    steps, width = x.shape
    units, dtype = len(model.recurrent[0][0]), model.out.dtype
    shapes = [*model.inputs, *model.recurrent, model.out, model.bias]
    states, kept = [], []
    for way in range(2):
        h = np.zeros((units, width), dtype)
        states.append(np.zeros((steps, units, width), dtype))
        kept.append([])
        for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
            a = model.inputs[way][:, x[t]]
            b = model.recurrent[way] @ h
            gates = sigmoid(a[: 2 * units] + b[: 2 * units])
            n = np.tanh(a[2 * units :] + gates[:units] * b[2 * units :])
            kept[way].append((t, h, gates, n, b[2 * units :]))
            h = n + gates[units:] * (h - n)
            states[way][t] = h
    both = np.concatenate(states, axis=1)  # steps, 2 units, width
    p = np.einsum("lu,tuw->ltw", model.out, both) + model.bias[:, :, None]
    p = softmax(p)
    loss = -float(np.log(np.maximum(p[labels, :, np.arange(width)], 1e-30)).mean())
    p[labels, :, np.arange(width)] -= 1
    p /= steps * width
    slopes = [np.zeros_like(v) for v in shapes]
    slopes[4][:] = np.einsum("ltw,tuw->lu", p, both)
    slopes[5][:, 0] = p.sum((1, 2))
    back = np.einsum("lu,ltw->tuw", model.out, p)
    for way in range(2):
        d = np.zeros((units, width), dtype)
        pre = np.zeros((steps, 3 * units, width), dtype)
        for t, h, gates, n, inner in reversed(kept[way]):
            d = d + back[t, way * units : (way + 1) * units]
            z, r = gates[units:], gates[:units]
            dn = d * (1 - z) * (1 - n * n)
            dz = d * (h - n) * z * (1 - z)
            dr = dn * inner * r * (1 - r)
            pre[t] = np.concatenate([dr, dz, dn])
            hidden = np.concatenate([dr, dz, dn * r])
            slopes[2 + way] += hidden @ h.T
            d = d * z + model.recurrent[way].T @ hidden
        flat = x.ravel()
        for g in range(3 * units):
            slopes[way][g] = np.bincount(flat, pre[:, g].ravel(), 256)
    return loss, slopes


def learn(data: np.ndarray, labels: np.ndarray, languages: list[str], settings: Settings) -> Model:
    """Adam over `data` (stretches x steps of bytes) in batches."""
    model = start(languages, settings)
    random = np.random.default_rng(settings.seed)
    shapes = [*model.inputs, *model.recurrent, model.out, model.bias]
    first, second = [np.zeros_like(p) for p in shapes], [np.zeros_like(p) for p in shapes]
    turn = 0
    for _ in range(settings.epochs):
        order = random.permutation(len(data))
        for at in range(0, len(order), settings.batch):
            rows = order[at : at + settings.batch]
            _, slopes = slopes_of(model, data[rows].T, labels[rows])
            turn += 1
            size = np.sqrt(sum(float((s * s).sum()) for s in slopes))
            for v, s, m1, m2 in zip(shapes, slopes, first, second, strict=True):
                s *= min(1.0, 1.0 / max(size, 1e-9))
                m1 += 0.1 * (s - m1)
                m2 += 0.01 * (s * s - m2)
                v -= settings.rate * (m1 / (1 - 0.9**turn)) / (np.sqrt(m2 / (1 - 0.99**turn)) + 1e-8)
    return model


def read_lanes(model: Model, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sum over the positions of each lane's label distribution: (languages, lanes). x is (steps,
    lanes) of bytes; lanes end after their length. Lanes come longest first."""
    steps, lanes = x.shape
    units = len(model.recurrent[0][0])
    active = np.searchsorted(-lengths, -np.arange(steps), side="left")  # lanes longer than t
    ahead = np.zeros((steps, units, lanes), np.float32)
    total = np.zeros((len(model.languages), lanes), np.float32)
    tables = [np.ascontiguousarray(t) for t in model.inputs]
    room = [np.empty((3 * units, lanes), np.float32) for _ in range(2)]

    def step(way: int, t: int, h: np.ndarray, k: int) -> np.ndarray:
        a, b = room[0][:, :k], room[1][:, :k]
        np.take(tables[way], x[t, :k], axis=1, out=a, mode="clip")
        np.matmul(model.recurrent[way], h, out=b)
        a[: 2 * units] += b[: 2 * units]
        gates = sigmoid(a[: 2 * units])
        n = a[2 * units :]
        b[2 * units :] *= gates[:units]
        n += b[2 * units :]
        np.tanh(n, out=n)
        h -= n
        h *= gates[units:]
        h += n
        return h

    h = np.zeros((units, lanes), np.float32)
    for t in range(steps):
        k = int(active[t])
        if not k:
            break
        h = step(0, t, np.ascontiguousarray(h[:, :k]), k)
        ahead[t, :, :k] = h
    half = model.out[:, :units], model.out[:, units:]
    h = np.zeros((units, 0), np.float32)
    for t in range(steps - 1, -1, -1):
        k = int(active[t])
        if not k:
            continue
        if h.shape[1] < k:
            h = np.concatenate([h, np.zeros((units, k - h.shape[1]), np.float32)], axis=1)
        h = step(1, t, h, k)
        total[:, :k] += softmax(half[0] @ ahead[t, :, :k] + half[1] @ h + model.bias)
    return total


def distributions(model: Model, texts: pa.Array, settings: Settings) -> np.ndarray:
    """(texts, languages): the mean over all positions of each text; an empty text has all 0."""
    data, offsets = text_bytes(pc.utf8_lower(texts.fill_null("")))
    out = np.zeros((len(texts), len(model.languages)))
    for first, last in spans(offsets, settings.lanes * settings.segment):
        sizes = np.diff(offsets[first : last + 1])
        counts = -(-sizes // settings.segment)
        owner = np.repeat(np.arange(len(sizes)), counts)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        begin = offsets[first:last][owner] + within * settings.segment
        length = np.minimum(settings.segment, offsets[first + 1 : last + 1][owner] - begin)
        order = np.argsort(-length, kind="stable")
        for at in range(0, len(order), settings.lanes):  # a long text takes several turns
            lanes = order[at : at + settings.lanes]
            places = begin[lanes] + np.arange(settings.segment)[:, None]
            x = data[np.minimum(places, len(data) - 1)].astype(np.intp)
            got = read_lanes(model, x, length[lanes])
            for k in range(len(model.languages)):
                out[first:last, k] += np.bincount(owner[lanes], got[k], len(sizes))
    return out / np.maximum(np.diff(offsets), 1)[:, None]


def windows(text: bytes, settings: Settings) -> Iterator[bytes]:
    """Stretches of equal length that cover the whole text: the last one ends with it and may
    overlap the one before, a shorter text is filled up with blanks."""
    room = max(0, len(text) - settings.steps)
    for at in (*range(0, room, settings.steps), room):
        yield text[at : at + settings.steps].ljust(settings.steps)


def stretches(text: bytes, key: int, settings: Settings) -> bytes:
    """The windows of a text one after the other; of more than `settings.stretches` those of smallest hash."""
    room = max(0, len(text) - settings.steps)
    count = -(-room // settings.steps) + 1
    if count <= settings.stretches:
        return b"".join(windows(text, settings))
    hashes = mix(mix(np.array([key % (1 << 64)], np.uint64)) + np.arange(count, dtype=np.uint64))
    chosen = np.sort(np.argpartition(hashes, settings.stretches)[: settings.stretches])
    begins = np.minimum(chosen * settings.steps, room)
    return np.frombuffer(text, np.uint8)[begins[:, None] + np.arange(settings.steps)].tobytes()


def chosen_texts(docs: DataFrame, settings: Settings) -> DataFrame:
    """doc_id, lang and text that are learned from: per language the texts of smallest id hash.

    A language of many texts is narrowed within each task by a bound on the hash that about twice
    as many texts meet as are wanted, so the rows that meet to be ranked don't grow with the table.
    """
    known = docs.select("doc_id", "text", "lang").filter("doc_id is not null and lang is not null")
    known = known.filter(~held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}"))
    sizes = known.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("__n"))
    share = F.lit(2.0 * settings.texts) / F.col("__n")
    bound = F.when(share < 1, F.lit(-(2.0**63)) + share * 2.0**64).otherwise(2.0**63)
    near = attach(known, sizes.select("lang", bound.alias("__bound")), ["lang"])
    near = near.filter(F.xxhash64("doc_id").cast("double") <= F.col("__bound"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = near.select("doc_id", "lang").distinct().withColumn("__k", F.row_number().over(order))
    ids = ids.filter(F.col("__k") <= settings.texts).drop("__k")
    return near.select("doc_id", "lang", "text").join(ids, ["doc_id", "lang"]).dropDuplicates(["doc_id", "lang"])


def fit(docs: DataFrame, settings: Settings = Settings()) -> Model:  # noqa: B008
    """A model from `text` and `lang` of rows that aren't held out.

    Rows with a NULL id, text or lang or without a letter teach nothing. Tasks cut the chosen texts
    into stretches; the one task that trains gets at most `settings.texts` texts per language and
    `settings.stretches` stretches of each, as bytes.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lower = pc.utf8_lower(batch.column(2)).to_pylist()
            ids = batch.column(0).to_pylist()
            rows = [stretches(t.encode(), k, settings) for k, t in zip(ids, lower, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], ["doc_id", "lang", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = [b for b in batches if b.num_rows]
        if not table:
            return
        found = pa.Table.from_batches(table).sort_by([("doc_id", "ascending"), ("lang", "ascending")])
        languages = sorted(pc.unique(found.column("lang")).to_pylist())
        data, offsets = text_bytes(found.column("rows"))
        data = data.reshape(-1, settings.steps)
        place = {name: k for k, name in enumerate(languages)}
        label = np.array([place[x] for x in found.column("lang").to_pylist()])
        labels = np.repeat(label, np.diff(offsets) // settings.steps)
        model = pickle.dumps(learn(data, labels, languages, settings))
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], ["model"])

    rows = chosen_texts(docs, settings).mapInArrow(lean(cut), "doc_id long, lang string, rows binary")
    got = rows.repartition(1).mapInArrow(lean(run), "model binary").collect()
    if not got:
        return start([], settings)
    return pickle.loads(got[0]["model"])


def predict(docs: DataFrame, model: Model, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """doc_id, held_out, lang_pred and score (the winner's share) for every row of `docs`.

    Row by row on the whole text. NULL, empty and letterless texts are `und` with score 0, as is
    everything when nothing was learned; ties go to the language first in order.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in (b.slice(k, 2000) for b in batches for k in range(0, b.num_rows, 2000)):
            lettered = batch.column(3).to_numpy(zero_copy_only=False)
            langs, scores = np.full(batch.num_rows, UNDETERMINED, object), np.zeros(batch.num_rows)
            if known.languages and lettered.any():
                share = distributions(known, batch.column(2), settings)
                best = share.argmax(1)
                scores = np.where(lettered, np.clip(share[np.arange(len(best)), best], 0, 1), 0.0)
                langs[lettered] = np.array(known.languages, object)[best[lettered]]
            columns = [batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score"])

    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text", lettered.alias("lettered"))
    return rows.mapInArrow(lean(run), "doc_id long, held_out boolean, lang_pred string, score double")


def keep(docs: DataFrame, model: Model, least: float = 0.5, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """The rows of `docs` whose text has a language that takes at least the share `least` of its
    positions, with the columns they came with. When nothing was learned all lettered texts stay."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in (b.slice(k, 2000) for b in batches for k in range(0, b.num_rows, 2000)):
            if known.languages and batch.num_rows:
                share = distributions(known, batch.column(place), settings)
                batch = batch.filter(pa.array(share.max(1) >= least))
            yield batch

    return docs.filter(lettered).mapInArrow(lean(run), docs.schema)
