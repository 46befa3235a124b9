"""The pipeline over small tables, each stage's table against brute force on the table before it,
and the registered queries that have no SQL."""

import itertools
import random
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from playmetrics.llm import extraction, language
from playmetrics.llm.queries import QUERIES, SQL, vocabulary
from tests.llm.test_corpus import DOCS, removed

STOPS = ["the", "of", "and", "to", "that", "have", "with", "be"]
CHANGES = {"en": {}, "de": {"a": "ü", "b": "z"}, "fr": {"a": "é", "b": "q"}}


def text(seed, lang, count=90):
    rand = random.Random(f"{seed} {lang}")
    word = lambda: "".join(rand.choice("abcdefgh") for _ in range(rand.randint(3, 7)))
    made = " ".join(word().translate(str.maketrans(CHANGES[lang])) if k % 8 else rand.choice(STOPS) for k in range(count))
    return made + "."


def table():
    """Documents of three languages, mixed ones, copies, near copies, shared passages, awkward rows."""
    rows = [(k, text(k, lang), lang) for k, lang in zip(range(180), itertools.cycle(CHANGES), strict=False)]
    rows += [(200 + k, " ".join(text(f"m{k}", lang, 60) for lang in CHANGES), "en") for k in range(4)]
    base, shared = text("base", "en", 160), text("shared", "de", 40)
    rows += [(301, base, "en"), (300, base, "en"), (302, base.replace("the", "and", 1), "en")]
    rows += [(310 + k, f"{text(f's{k}', 'de')}\n{shared}", "de") for k in range(3)]
    rows += [(400, None, "en"), (401, "", "en"), (402, " \n ", None), (403, "too short", "fr"), (None, "short", None)]
    return [(doc, t, lang, len(t or ""), "clash") for doc, t, lang in rows]


@pytest.fixture
def folder(spark, tmp_path):
    def write(rows):
        spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path)

    return write


@pytest.fixture
def stages(monkeypatch, tmp_path):
    """Where each stage's table lies."""
    monkeypatch.setattr(corpus_pipeline, "scratch_path", lambda spark, name: f"{tmp_path}/{name}")
    return [f"{tmp_path}/{name.replace(' ', '-')}" for name, _ in corpus_pipeline.STAGES]


def shares(model, data):
    """Mean label distribution of a text, one byte and one segment at a time."""
    total, units = np.zeros(len(model.languages)), model.recurrent[0].shape[1]
    for at in range(0, len(data), 128):
        part, states = data[at : at + 128], []
        for way in range(2):
            h, seen = np.zeros(units), []
            for byte in part if way == 0 else part[::-1]:
                a, b = model.inputs[way][:, byte], model.recurrent[way] @ h
                r, z = np.split(1 / (1 + np.exp(-(a[: 2 * units] + b[: 2 * units]))), 2)
                n = np.tanh(a[2 * units :] + r * b[2 * units :])
                h = n + z * (h - n)
                seen.append(h)
            states.append(seen if way == 0 else seen[::-1])
        for h in np.concatenate(states, axis=1):
            e = np.exp(model.out @ h + model.bias[:, 0])
            total += e / e.sum()
    return total / len(data)


def shingles(t):
    w = t.split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def packed(rows, docs):
    """Every document's tokens have their place, and sequences have neither gaps nor overlaps."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    for doc, t in docs.items():
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        parts = [ids[k : k + 4096] for k in range(0, len(ids), 4096)]
        own = sorted((x["start"], x["length"], x["ids_crc32"]) for x in rows if x["doc_id"] == doc)
        assert own == [(k * 4096, len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for k, p in enumerate(parts)]
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        ends = list(itertools.accumulate(n for _, n in sorted(own)))
        assert [0, *ends[:-1]] == [o for o, _ in sorted(own)] and ends[-1] <= 4096


def test_pipeline_stage_by_stage(spark, folder, stages):
    path = folder(table())
    rows = corpus_pipeline.run(spark, path).collect()
    kept, known, single, cut = (spark.read.parquet(s) for s in stages[:4])
    whole = spark.read.parquet(f"{path}/documents.parquet")
    assert kept.columns == known.columns == single.columns == cut.columns == whole.columns

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    right = {r[0] for r in con.execute(f"SELECT doc_id FROM ({SQL['op9_quality']}) WHERE kept").fetchall()}
    one = by_id(kept)
    assert set(one) == right and 150 < len(right) < len(table())

    model, two = language.fit(kept), by_id(known)
    best = {k: shares(model, r["text"].lower().encode()).max() for k, r in one.items()}
    assert set(two) == {k for k, share in best.items() if share >= 0.5} and len(two) < len(one)

    sets, leader = {k: shingles(r["text"]) for k, r in two.items()}, {k: k for k in two}
    for a, b in itertools.combinations(sorted(sets), 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            old, new = max(leader[a], leader[b]), min(leader[a], leader[b])
            leader = {k: new if v == old else v for k, v in leader.items()}
    three = by_id(single)
    assert set(three) == set(leader.values()) and len(three) < len(two)
    assert all(three[k] == two[k] == one[k] for k in three)

    four = by_id(cut)
    order = [(k, three[k]["text"].encode()) for k in sorted(three)]
    gone = {doc: n for doc, _, n, _, _ in removed(order)}
    assert sum(gone.values()) > 0 and set(four) == set(three)
    assert all(len(four[k]["text"].encode()) <= len(t) - gone[k] for k, t in order)
    assert all(four[k]["text"] == three[k]["text"] for k in four if not gone[k])
    assert all(four[k]["n_chars"] == len(four[k]["text"]) for k in four)
    assert {r["doc_id"] for r in rows} == set(four)
    packed(rows, {k: r["text"] for k, r in four.items()})


def test_pipeline_of_an_empty_table(spark, folder, stages):
    path = folder([])
    assert corpus_pipeline.run(spark, path).collect() == []
    assert all(spark.read.parquet(s).columns == [c.split(" ")[0] for c in DOCS.split(", ")] for s in stages[:4])


@pytest.mark.parametrize("rows", [table(), []], ids=["small", "empty"])
def test_registered_queries_over_documents(spark, folder, rows):
    path = folder(rows)
    docs = {r[0]: r[1] for r in rows}
    labels = spark.createDataFrame([(k, k % 2) for k in docs if k is not None], "doc_id long, toxic int")
    labels.write.parquet(f"{path}/labels.parquet")
    got = {n: QUERIES[n](spark, path).collect() for n in ("op3_similar", "op5_toxicity", "op6_language", "op7_sentencepieces", "op8_suffixes", "op10_packing")}
    for found in got.values():
        assert {r["doc_id"] for r in found} == set(docs)
    order = sorted(((k, (t or "").encode()) for k, t in docs.items()), key=lambda r: (r[0] is None, r[0] or 0))
    assert sorted(map(tuple, got["op8_suffixes"]), key=str) == sorted(removed(order), key=str)
    assert all(r["round_trip"] for r in got["op7_sentencepieces"] if docs[r["doc_id"]])
    classes = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in got["op3_similar"]}
    assert not rows or classes[300] == classes[301] == classes[302] == (300, 2)
    packed(got["op10_packing"], docs)


@pytest.mark.parametrize("count", [16, 0])
def test_registered_queries_over_vectors_and_pages(spark, tmp_path, count):
    x = np.random.default_rng(2).normal(size=(count, 4))
    vectors = [(k, v.tolist()) for k, v in enumerate(x)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    pages = [(k, f"u{k}", f"<nav>menu</nav><p>{text(k, 'en', 20 + k)}</p>" if k else None) for k in range(count)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    near = sorted(QUERIES["op2_neighbours"](spark, str(tmp_path)).collect(), key=lambda r: r["rank"])
    x = x.astype(np.float32).astype(float)
    assert [r["vec_id"] for r in near] == sorted(range(1, count), key=lambda k: -(x[0] * x[k]).sum())
    found = {r["page_id"]: r["n_chars"] for r in QUERIES["op4_extraction"](spark, str(tmp_path)).collect()}
    assert found == {k: len(extraction.main_text(html)) for k, _, html in pages}
