"""Toxicity by logistic regression on hashed word n-grams and skip-grams, learned by FTRL-proximal.

Every coordinate has a learning rate of its own and an L1 penalty, so most weights are exactly 0
and the rest, at most `2**bits`, are small enough to send to every task whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playmetrics.llm.common import about, held_out, lean, mix, spans, text_bytes, word_bounds, word_hashes

IN_WORD = np.zeros(256, bool)
IN_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


class Settings(NamedTuple):
    """`sample`: at most so many labelled rows are learned from (those of smallest id hash)."""

    sample: int = 8000
    bits: int = 20
    skips: tuple[int, ...] = (1, 2)  # distance of the two words: 1 is a bigram
    alpha: float = 4.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 0.1
    epochs: int = 5
    seen: int = 5  # features of fewer learned texts are left out, as in sparse online learning
    prior: float = 0.25  # share of toxic texts that a score supposes, whatever the sample's share


class Weights(NamedTuple):
    bias: float
    index: np.ndarray
    value: np.ndarray


def features(texts: pa.Array, settings: Settings) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(first text, text of each feature, feature, texts) for runs of texts: all single words, and
    all pairs at the given distances. A feature may repeat."""
    data, offsets = text_bytes(pc.utf8_lower(texts.fill_null("")))
    shift = np.uint64(64 - settings.bits)
    for start, stop in spans(offsets, 1 << 18):
        part, bounds = data[offsets[start] : offsets[stop]], offsets[start : stop + 1] - offsets[start]
        begins, ends, owner = word_bounds(part, bounds, IN_WORD[part])
        words = word_hashes(part, begins, ends)
        found, owners = [words >> shift], [owner]
        for skip in settings.skips:
            if len(words) <= skip:
                continue
            pair = mix(words[:-skip] * np.uint64(3 + 2 * skip) + (words[skip:] ^ np.uint64(skip)))
            both = owner[:-skip] == owner[skip:]
            found.append((pair >> shift)[both])
            owners.append(owner[:-skip][both])
        yield start, np.concatenate(owners), np.concatenate(found).astype(np.int64), stop - start


def learn(texts: pa.Array, labels: np.ndarray, settings: Settings) -> Weights:
    """FTRL-proximal over the texts in order, each feature present or not. Without rows all is 0."""
    z, n = np.zeros((1 << settings.bits) + 1), np.zeros((1 << settings.bits) + 1)
    bias = 1 << settings.bits  # the last coordinate, which every text has and no penalty holds down
    rows: list[np.ndarray] = []
    for _, owner, found, count in features(texts, settings):
        order = np.argsort(owner, kind="stable")
        cuts = np.searchsorted(owner[order], np.arange(count + 1))
        rows += [np.append(np.unique(found[order[a:b]]), bias) for a, b in zip(cuts, cuts[1:], strict=False)]
    often = np.zeros(len(z), np.int32)
    for at in rows:
        often[at] += 1
    often[bias] = settings.seen
    rows = [at[often[at] >= settings.seen] for at in rows]
    penalty = np.full(len(z), settings.l1)
    penalty[bias] = 0

    def weights(at: np.ndarray) -> np.ndarray:
        pull = np.maximum(np.abs(z[at]) - penalty[at], 0)
        return -np.sign(z[at]) * pull / ((settings.beta + np.sqrt(n[at])) / settings.alpha + settings.l2)

    for _ in range(settings.epochs):
        for at, label in zip(rows, labels, strict=True):
            w = weights(at)
            slope = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            more = n[at] + slope * slope
            z[at] += slope - (np.sqrt(more) - np.sqrt(n[at])) / settings.alpha * w
            n[at] = more
    all_ = weights(np.arange(len(z)))
    index = np.flatnonzero(all_[:-1]).astype(np.int32)
    toxic = min(max(float(labels.mean()), 1e-6), 1 - 1e-6)
    shift = np.log(settings.prior / (1 - settings.prior)) - np.log(toxic / (1 - toxic))
    return Weights(float(all_[bias] + shift), index, all_[index].astype(np.float32))


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Weights:  # noqa: B008
    """Weights from rows of `labels` (doc_id, toxic) whose id isn't held out.

    A NULL id or label teaches nothing; ids labelled twice count as toxic if either label does.
    At most `settings.sample` rows reach the one task that learns.
    """
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    known = labels.filter("doc_id is not null and toxic is not null").select("doc_id", "toxic")
    known = known.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    chosen = about(known, "doc_id", settings.sample, known.count()).orderBy(*order).limit(settings.sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = rows.orderBy(*order, F.xxhash64("text")).limit(settings.sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            table = pa.Table.from_batches(held)
            texts = pa.concat_arrays(table.column("text").chunks)
            got = learn(texts, table.column("label").to_numpy().astype(float), settings)
            columns = [pa.array([got.bias]), pa.array([got.index.tobytes()]), pa.array([got.value.tobytes()])]
            yield pa.RecordBatch.from_arrays(columns, ["bias", "index", "value"])

    got = rows.select("text", "label").mapInArrow(lean(run), "bias double, index binary, value binary").collect()
    if not got:
        return Weights(0.0, np.zeros(0, np.int32), np.zeros(0, np.float32))
    return Weights(got[0]["bias"], np.frombuffer(got[0]["index"], np.int32), np.frombuffer(got[0]["value"], np.float32))


def score(
    docs: DataFrame, weights: Weights, settings: Settings = Settings(), threshold: float = 0.7  # noqa: B008
) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of `docs`; a NULL or empty text has the
    score of no features. Row by row, on the whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        table = np.zeros(1 << settings.bits, np.float32)
        table[known.index] = known.value
        for batch in batches:
            total = np.full(batch.num_rows, known.bias)
            for start, owner, found, _ in features(batch.column(2), settings):
                hit = table[found] != 0
                once = np.unique(owner[hit] * len(table) + found[hit])
                np.add.at(total, start + once // len(table), table[once % len(table)].astype(float))
            value = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            columns = [batch.column(0), batch.column(1), pa.array(value), pa.array((value >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(lean(run), "doc_id long, held_out boolean, score double, predicted int")
