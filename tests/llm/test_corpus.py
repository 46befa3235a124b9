"""The corpus operators against brute force on small tables, with the awkward cases of each."""

import hashlib
import itertools
import random
import time
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from playmetrics.llm import (
    extraction, language, neighbours, packing, quality, sentencepieces, similar, suffixes, toxicity, warc,
)
from playmetrics.llm.components import components
from playmetrics.llm.queries import vocabulary
from playmetrics.operators.sizing import scratch_path

DOCS = "doc_id long, text string, lang string, n_chars long, __h string"


def words(seed, count):
    rand = random.Random(seed)
    return " ".join("".join(rand.choice("abcdefgh") for _ in range(rand.randint(2, 7))) for _ in range(count))


def documents(spark):
    """Copies, near copies, shared passages, NULLs, blanks, short and long texts, a repeated id."""
    base, shared = words(1, 120), words(2, 60)
    near = base.split(" ")
    near[60] = "changed"
    texts = [
        base, base, " ".join(near), f"{words(3, 40)}\n{shared}", f"{shared}\n{words(4, 40)}", None, "", " \n ", "one two",
        "one two", words(5, 6000), f"é{shared}é", "ab" * 150, words(6, 30).upper(),
    ]
    rows = [(k, t, "xx", len(t or ""), "clash") for k, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, base, None, 0, None), (3, texts[3], "xx", 0, "again")], DOCS)


def test_similar(spark):
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in similar.join(documents(spark)).collect()}
    assert got[0] == (0, 2) and got[1] == (0, 2) and got[2] == (0, 2)
    assert got[8] == (8, 1) and got[9] == (8, 1) and got[None] == (None, 0)
    assert all(got[k] == (k, 0) for k in (3, 4, 5, 6, 7, 10, 11, 12, 13))
    empty = similar.join(spark.createDataFrame([], DOCS))
    assert empty.collect() == []
    kept = similar.keep_one(documents(spark))
    assert kept.columns == documents(spark).columns
    assert sorted(r["doc_id"] for r in kept.filter("doc_id is not null").collect()) == [0, 3, 3, 4, 5, 6, 7, 8, 10, 11, 12, 13]


def test_similar_group_larger_than_a_block(spark):
    base = words(7, 80).split(" ")
    rows = [(k, " ".join(base[:79] + [f"end{k}"])) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = similar.join(docs, similar.Settings(block=16)).collect()
    assert {(r["class_id"], r["n_links"]) for r in got} == {(0, 59)} and len(got) == 60


def spread_texts(seed, near, far):
    """Texts of 200 words: `near` pairs of similarity about 0.95, `far` pairs of about 0.81."""
    rows, rand = [], random.Random(seed)
    for k in range(near + far):
        text = words(1000 * seed + k, 200).split(" ")
        other = list(text)
        for p in (10,) if k < near else (10, 50, 100, 150):
            other[p] = f"changed{rand.randint(0, 9)}"
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(other))]
    return rows


def shingle_links(rows):
    """Pairs of similarity 0.8 or more, by sets of shingles."""
    sets = {}
    for k, text in rows:
        parts = text.split()
        sets[k] = {tuple(parts[p : p + 5]) for p in range(max(1, len(parts) - 4))}
    return {
        (a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    }


@pytest.mark.parametrize("block", [4, 1024])
def test_forest_shortens_prefixes_by_what_it_found(spark, block):
    ends = []
    for near, far in ((150, 0), (60, 60)):
        rows = spread_texts(near, near, far)
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        settings = similar.Settings(trees=16, depth=6, block=block)
        _, classes = similar.class_table(similar.signatures(docs, settings))
        found = similar.search(classes.drop("k2"), docs, settings)
        expected = shingle_links(rows)
        links = found.seen.filter("b is not null").select("a", "b").collect()
        assert {(min(r), max(r)) for r in links} == expected
        assert found.seen.filter("b is null").groupBy().sum("links").first()[0] == 2 * len(expected)
        ends.append(sum(found.depths))
    assert ends[0] > ends[1]


def test_forest_target_recall():
    settings = similar.Settings()
    full = np.full(settings.trees, settings.depth)
    none = similar.shortened(np.zeros(settings.bins), full, settings)
    assert similar.reached(np.array([0.8]), none)[0] >= settings.recall > similar.reached(np.array([0.8]), full)[0]
    close = np.zeros(settings.bins)
    close[-4] = 100_000
    assert (similar.shortened(close, full, settings) == full).all()
    wide = np.full(settings.bins, 10_000.0)
    assert similar.shortened(wide, full, settings).sum() <= full.sum()


def test_runs_over_partitions(spark):
    """A node of 300 texts over many range partitions has each member once, numbered through."""
    base = words(7, 80).split(" ")
    docs = spark.createDataFrame([(k, " ".join(base[:79] + [f"end{k}"])) for k in range(300)], "doc_id long, text string")
    settings = similar.Settings()
    _, classes = similar.class_table(similar.signatures(docs, settings))
    step = similar.Step(np.full(settings.trees, settings.depth))
    got = {}
    for r in similar.members_of_nodes(classes, step, settings).collect():
        got.setdefault(r["key"], []).append((r["nth"], r["rep"], r["n"]))
    assert max(len(v) for v in got.values()) > 200
    for rows in got.values():
        assert sorted(nth for nth, _, _ in rows) == list(range(len(rows))) and {n for _, _, n in rows} == {len(rows)}
        assert len({rep for _, rep, _ in rows}) == len(rows)
    sig = similar.unpacked(pa.array([bytes(r["sig"]) for r in classes.collect()]), settings)
    keys = similar.prefix_keys(sig, step.now, settings)
    _, often = np.unique(keys, return_counts=True)
    assert sorted(len(v) for v in got.values()) == sorted(often[often > 1].tolist())


def test_similar_class_larger_than_a_crowd(spark):
    text = words(8, 50)
    docs = spark.createDataFrame([(k, text if k < 40 else words(k, 50)) for k in range(60)], "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in similar.join(docs, similar.Settings(crowd=8)).collect()}
    assert got == {k: (0, 39) if k < 40 else (k, 0) for k in range(60)}


def test_components(spark):
    edges = [(k + 1, k) for k in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[k] == 0 for k in range(41)) and got[100] == got[101] == got[102] == 100


def removed(rows):
    """Brute force over (doc_id, bytes) in corpus order."""
    seen, out = set(), []
    for doc, data in rows:
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - 99):
            if data[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(data[p : p + 100])
        left = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        runs = sum(1 for g, _ in itertools.groupby(gone.tolist()) if g)
        out.append((doc, len(data), int(gone.sum()), runs, hashlib.sha256(left).hexdigest()))
    return out


def test_suffixes(spark):
    docs = documents(spark)
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    got = [tuple(r) for r in suffixes.deduplicate(docs, None, bucket_bytes=1 << 14).collect()]
    key = lambda r: (str(r[0]), r[2])
    assert sorted(got, key=key) == sorted(removed(rows), key=key)
    stripped = suffixes.strip(docs)
    assert stripped.columns == docs.columns and stripped.count() == docs.count()
    assert suffixes.deduplicate(spark.createDataFrame([], DOCS)).collect() == []


def test_suffixes_in_blocks():
    data = np.frombuffer(words(9, 400).encode(), np.uint8)
    strings = lambda s: {(a, o) for a, lo, hi in zip(s.start, s.low, s.high, strict=True) for o in range(lo, hi + 1)}
    whole = suffixes.suffixes(data, np.array([0, len(data)]))
    assert strings(whole) == strings(suffixes.suffixes(data, np.array([0, len(data)]), block=130))
    assert sorted(a - o for a, o in strings(whole)) == list(range(len(data) - 99))


def test_quality(spark):
    docs = documents(spark)
    for r in quality.judge(docs).collect():
        text = r["__row"]["text"] or ""
        found = re.findall(r"[^\x20\x09-\x0D]+", text)
        five = [tuple(found[k : k + 5]) for k in range(len(found) - 4)]
        twice = {k + i for k, g in enumerate(five) if five.count(g) > 1 for i in range(5)} if len(found) < 500 else set()
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(found), sum(map(len, found)), len(twice))
    text = " ".join(["a b c d e f"] * 3 + ["the cat sat on the mat of it"])
    row = quality.judge(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["n_repeat_words"] == 18 and row["base_failed"] and not row["kept"]
    assert quality.keep(docs).columns == docs.columns


@pytest.mark.parametrize("size", [7, 16, 100])
def test_pieces_in_chunks(spark, size):
    import sentencepiece

    model = vocabulary("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=model)
    texts = ["  a  b ", "x" * 300, "supercalifragilistic" * 20, words(3, 60), "ñandú 🙂\n\n" * 9, "", None, "▁x", " " * 50]
    docs = spark.createDataFrame([*enumerate(texts), (3, texts[3])], "doc_id long, text string")
    rows = sentencepieces.decode(sentencepieces.encode(docs, model, size), model).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        text = texts[r["doc_id"]]
        assert r["ids"] == (None if text is None else library.encode(text))
        assert text is None or "▁" in text or r["decoded"] == text


def test_unigram_scan_against_all_paths():
    """With scores as weights the scan finds the best of all segmentations."""
    rand = random.Random(4)
    for _ in range(30):
        made = ["".join(rand.choice("ab▁") for _ in range(rand.randint(1, 3))) for _ in range(12)]
        scores = {p: -rand.random() * 5 for p in made if not re.search("[ab]▁", p)}
        pieces = sentencepieces.Pieces({p: k for k, p in enumerate(scores)}, scores, [], 99, True)
        text = sentencepieces.normal("".join(rand.choice("ab ") for _ in range(14)))
        best = pieces.advance(text, (0, ""), len(text))[-1][0]
        matrices = []
        for at in range(0, len(text), 5):
            end, matrix = min(at + 5, len(text)), {}
            for a, b, v in sentencepieces.transfer(pieces, text, at, end, end == len(text)):
                matrix.setdefault(a, {})[b] = v
            matrices.append(matrix)
        found = sentencepieces.scanned(matrices)[-1][0, ""]
        assert max(v for s, v in found.items() if s[0] == 0) == pytest.approx(best)


def test_packing(spark):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    docs = documents(spark).filter("doc_id is not null").dropDuplicates(["doc_id"])
    rows = packing.pack_documents(docs, path).collect()
    for r in docs.collect():
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        own = sorted((x["start"], x["length"], x["ids_crc32"]) for x in rows if x["doc_id"] == r["doc_id"])
        parts = [ids[k : k + 4096] for k in range(0, len(ids), 4096)]
        assert own == [(k * 4096, len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for k, p in enumerate(parts)]
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        ends = list(itertools.accumulate(n for _, n in sorted(places)))
        assert [0, *ends[:-1]] == [o for o, _ in sorted(places)] and ends[-1] <= 4096
    assert packing.pack_documents(spark.createDataFrame([], DOCS), path).collect() == []


def test_plan_is_near_the_bound():
    sizes = np.minimum(4096, np.random.default_rng(1).lognormal(6.5, 1.1, 5000).astype(int) + 1)
    lengths, counts = np.unique(sizes, return_counts=True)
    places = packing.plan(dict(zip(lengths.tolist(), counts.tolist(), strict=True)))
    used = {s for _, _, times, first, _ in places for s in range(first, first + times)}
    assert len(used) <= 1.03 * sizes.sum() / 4096 + 1


def test_archives(spark):
    big, html = "<p>" + "x" * 2000, "<p>small"
    rows = [(1, "u", big), (2, None, big), (3, "u\n", html), (4, "u", html), (5, "u", None), (None, "u", big), (6, "é", "é" * 700)]
    rows += [(k, f"http://a/{k}", f"<html>{words(k, 200)}") for k in range(10, 60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = scratch_path(spark, "warc")
    warc.write(warc.roles(pages), path, archive_bytes=1 << 15, dictionary_bytes=1024)
    got = {r["page_id"]: r for r in warc.load(spark, path).collect()}
    assert len(got) == len(rows)
    assert got[2]["record_type"] == "response" and bytes(got[2]["payload"]) == big.encode()
    assert got[1]["refers_to"] == 2 and got[None]["refers_to"] == 2 and got[1]["payload_bytes"] == 2003
    assert got[3]["record_type"] == got[4]["record_type"] == "response" and got[5]["payload_bytes"] == 0
    for k, _, text in rows:
        assert got[k]["payload_digest"] == hashlib.sha1((text or "").encode()).hexdigest()


def test_extraction(spark):
    page = (
        "<head><title>T</title></head><body><nav><a href='/'>Home</a></nav><div class=ad>Buy the best of it now</div>"
        "<article><h1>Head &amp; line</h1><p>First \n one.<p><b>A second, longer one that goes on for the length that is asked."
        "<script>x='</p>'</script></article><div id=comments><p>I think that this is the best of all</p></div><footer>&copy; us"
    )
    assert extraction.main_text(page) == "Head & line First one. A second, longer one that goes on for the length that is asked."
    assert extraction.main_text(None) == extraction.main_text("") == extraction.main_text("<nav><a>x</a></nav>") == ""
    df = spark.createDataFrame([(1, None, page), (1, None, page), (None, "u", None)], "page_id long, url string, html string")
    assert sorted(r["n_chars"] for r in extraction.extract(df).collect()) == [0, 86, 86]


FILLED = "The house on the hill was built by a man who came from the north in the year of the great storm, and it is said that "
LONGER = FILLED + FILLED + "the people of the town helped him with the stones for it."
POLISH = "Dom na wzgórzu stał od lat i nikt w nim nie był, a to co o nim wiemy nie jest pewne, bo nikt z nas nie był na wzgórzu. "
EXTRACTED = {
    # Density rules decide without an article element or telling names.
    "no article": (
        f"<body><div><a href=/a>Home</a> <a href=/b>News and more</a></div><div><p>Title of it<p>{LONGER}<p>{LONGER}</div>"
        "<div><a href=/c>Next page</a></div><div>&copy; 2020 by the firm</div>",
        f"Title of it {LONGER} {LONGER}",
    ),
    "own stop words": (f"<div><p>{POLISH * 3}<p>{POLISH * 2}<p>Koniec.<p>{POLISH * 3}</div>", " ".join(f"{POLISH * 3} {POLISH * 2} Koniec. {POLISH * 3}".split())),
    "no blanks between words": ("<div><p>" + "山上的房子" * 60 + "</div>", "山上的房子" * 60),
    "self-closed": (f"<article><svg/><p>{LONGER}</p><iframe src=x /><p>The end.</p></article>", f"{LONGER} The end."),
    "unclosed frame": (f"<article><p>{LONGER}</p><iframe src=x>no frames<p>The end.</p></article>", f"{LONGER} The end."),
    "unclosed script": (f"<article><p>{LONGER}</p><script>var x = '<p>text</p>'", LONGER),
    "form around the page": (f"<form><div><p>{LONGER}<p>{LONGER}</div></form>", f"{LONGER} {LONGER}"),
    "form beside the text": (f"<div><p>{LONGER}</div><form><p>Your name and the mail of your own to be sent to us by this form, as it is</form>", LONGER),
    "class words in parts": (f"<article class='side-by-side'><div class=entry-header><h1>Title</h1></div><p>{LONGER}</article>", f"Title {LONGER}"),
    "comments": (f"<article><p>{LONGER}</article><div class=comment-list><p>{LONGER}</div>", LONGER),
    "notices": (f"<article><p>{LONGER}<div>Advertisement</div><p>{LONGER}<div>Share this:</div></article>", f"{LONGER} {LONGER}"),
    "references": (f"<article><p>{LONGER} &lt;b&gt; &amp; x&#8211;y</article>", f"{LONGER} <b> & x\N{EN DASH}y"),
}


@pytest.mark.parametrize("name", EXTRACTED)
def test_extraction_by_hand(name):
    page, text = EXTRACTED[name]
    assert extraction.main_text(page) == text


def test_extraction_by_densities_alone():
    """Link and stop-word densities decide where no name tells anything."""
    page, text = EXTRACTED["no article"]
    assert extraction.main_text(page, extraction.Limits(names=False)) == text
    found = extraction.blocks(page)
    assert not any(b.dropped or b.vouched for b in found)
    assert extraction.first_pass(found, extraction.Limits()) == ["bad", "short", "good", "good", "bad", "bad"]


def test_extraction_of_long_and_malformed_pages():
    begin = time.perf_counter()
    many = "<div>" * 30_000 + "</section>" * 30_000 + "<svg>" * 30_000 + f"<article><p>{LONGER}" + "</p><" * 1000
    assert extraction.main_text(many).startswith(LONGER)
    assert extraction.main_text(f"<article><p>{'a ' * 500_000}") == " ".join(["a"] * 500_000)
    assert extraction.main_text("<p" + "'" * 50_000) == extraction.main_text("<!--" * 20_000) == ""
    assert time.perf_counter() - begin < 20


def test_language_slopes_against_differences():
    """Backpropagation through time against finite differences of the loss, for every kind of parameter."""
    settings = language.Settings(units=3)
    single = language.start(["a", "b", "c"], settings)
    parts = [np.array(v, np.float64) for v in (*single.inputs, *single.recurrent, single.out, single.bias)]
    model = language.Model(single.languages, parts[:2], parts[2:4], parts[4], parts[5])
    random_ = np.random.default_rng(5)
    x, labels = random_.integers(97, 103, (7, 4)), np.array([0, 1, 2, 1])
    _, slopes = language.slopes_of(model, x, labels)
    for part, slope in zip(parts, slopes, strict=True):
        seen = np.argwhere(np.abs(slope) > 0)
        for at in map(tuple, seen[random_.permutation(len(seen))[:12]]):
            old, ends = part[at], []
            for move in (1e-5, -1e-5):
                part[at] = old + move
                ends.append(language.slopes_of(model, x, labels)[0])
            part[at] = old
            assert slope[at] == pytest.approx((ends[0] - ends[1]) / 2e-5, rel=1e-4, abs=1e-8)


def test_language_stretches():
    settings = language.Settings(steps=8, stretches=16)
    short = b"a text of some length"
    assert language.stretches(short, 3, settings) == b"".join(language.windows(short, settings))
    text = bytes(range(32, 122)) * 2000
    got = language.stretches(text, 3, settings)
    assert len(got) == 16 * 8 and got == language.stretches(text, 3, settings) != language.stretches(text, 4, settings)
    assert all(got[k : k + 8] in text for k in range(0, len(got), 8))
    assert len(language.stretches(b"x" * 20_000_000, -1, language.Settings())) == 1024 * 64


def test_language_chooses_the_smallest_hashes(spark):
    from pyspark.sql import functions as F

    docs = spark.range(6000).select(
        F.col("id").alias("doc_id"), F.lit("some words").alias("text"), F.when(F.col("id") % 3 > 0, "aa").otherwise(F.concat(F.lit("b"), F.col("id") % 2)).alias("lang")
    )
    docs = docs.unionByName(docs.filter("doc_id < 50"))
    got = language.chosen_texts(docs, language.Settings(texts=60)).collect()
    rows = docs.filter("pmod(crc32(cast(cast(doc_id as string) as binary)), 3) <> 1").select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).distinct().collect()
    for lang in ("aa", "b0", "b1"):
        best = sorted((r["h"], r["doc_id"]) for r in rows if r["lang"] == lang)[:60]
        assert sorted(r["doc_id"] for r in got if r["lang"] == lang) == sorted(k for _, k in best)


def test_neighbours(spark):
    random_ = np.random.default_rng(3)
    x = random_.normal(size=(400, 16))
    x[7] = x[3]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(500, None), (501, [0.0] * 16), (502, [float("nan")] * 16), (None, x[0].tolist()), (20, x[20].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    from pyspark.sql import functions as F

    got = neighbours.search(df, F.col("vec_id") % 20 == 0, 20).collect()
    asked = range(0, 400, 20)
    assert len(got) == 20 * len(asked)
    hits = 0
    for q in asked:
        best = sorted(((-(x[q] * x[k]).sum(), k) for k in range(400) if k != q))[:20]
        hits += len({k for _, k in best} & {r["vec_id"] for r in got if r["query_id"] == q})
    assert hits >= 0.9 * len(got)
    few = neighbours.search(df.filter("vec_id < 5"), F.col("vec_id") % 20 == 0, 20)
    assert [r["rank"] for r in few.orderBy("rank").collect()] == [1, 2, 3, 4]


@pytest.mark.parametrize("width", [1.0, 1e6])  # of that width all vectors fall into one bucket
def test_neighbours_of_a_crowded_bucket(spark, width):
    x = np.random.default_rng(4).normal(size=(300, 8))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    from pyspark.sql import functions as F

    settings = neighbours.Settings(width=width, block=32, queries=16, turn=5)
    got = neighbours.search(df, F.col("vec_id") % 2 == 0, 10, settings=settings).collect()
    assert len(got) == 150 * 10
    for q in range(0, 300, 2) if width > 1 else ():
        best = sorted(((-(x[q] * x[k]).sum(), k) for k in range(300) if k != q))[:10]
        assert [k for _, k in best] == [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q]


def test_neighbours_among_few_vectors_with_copies(spark):
    x = [[1.0, 0.0]] * 12 + [[float(np.cos(a)), float(np.sin(a))] for a in np.linspace(1, 5, 9)]
    df = spark.createDataFrame(list(enumerate([*x, [0.5, 0.5, 0.5]])), "vec_id long, embedding array<double>")
    from pyspark.sql import functions as F

    # The query meets its copies, more rows than there are different vectors, and nothing else.
    settings = neighbours.Settings(tables=1, probes=1, width=1e-3)
    got = neighbours.search(df, F.col("vec_id") == 0, 20, settings=settings).orderBy("rank").collect()
    assert {r["vec_id"] for r in got} == set(range(1, 21)) and len(got) == 20
    assert [r["vec_id"] for r in got[:11]] == list(range(1, 12))


def test_neighbours_of_several_lengths_and_one_long_vector(spark):
    from pyspark.sql import functions as F

    random_ = np.random.default_rng(12)
    x = [*random_.normal(size=(600, 24)), *random_.normal(size=(300, 6)), *random_.normal(size=(40, 3))]
    x[5] = x[5] * 1e6
    x[6] = x[6] * 1e-6
    x[601] = x[601] * 1e250
    df = spark.createDataFrame([(k, v.tolist(), "a") for k, v in enumerate(x)], "vec_id long, embedding array<double>, shelf string")
    got: dict[int, set] = {}
    for r in neighbours.search(df, F.col("vec_id") % 5 == 0, 10).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    for begin, end in ((0, 600), (600, 900), (900, 940)):
        hits = []
        for q in range(begin, end, 5):
            best = sorted((-(x[q] * x[k]).sum(), k) for k in range(begin, end) if k != q)[:10]
            hits.append(len({k for _, k in best} & got[q]) / 10)
            assert len(got[q]) == 10
        assert np.mean(hits) >= 0.9
    assert all(got[q] == set() or 5 in got[q] for q in range(0, 600, 5) if q != 5 and x[q] @ x[5] > 0)
    assert neighbours.search(df.limit(0), F.col("vec_id") % 5 == 0, 10).count() == 0
    assert neighbours.search(df, F.lit(False), 10).count() == 0


def test_a_shelf_gets_the_cheapest_plan_that_finds_enough():
    random_ = np.random.default_rng(13)
    settings, plan = neighbours.Settings(tables=4, probes=16), neighbours.Plan(longest=1.0)
    shares = []
    for spread in (1.0, 0.2):  # the nearer the neighbours, the fewer rows are compared
        asked = random_.normal(size=(20, 32))
        asked /= np.linalg.norm(asked, axis=1)[:, None]
        near = [q + spread * random_.normal(size=(10, 32)) / 32**0.5 for q in asked]
        near = [n / np.linalg.norm(n, axis=1)[:, None] for n in near]
        sample = random_.normal(size=(500, 32))
        sample /= np.linalg.norm(sample, axis=1)[:, None]
        got, recall, share = neighbours.tuned(sample, asked, near, 10**7, 10**5, plan, settings)
        found, met = [], 0
        for q, n in zip(asked, near, strict=True):
            visited = [set(keys) for keys in neighbours.probe_keys(q[None], got, settings)[0].tolist()]
            found += [any(k in v for k, v in zip(row, visited, strict=True)) for row in neighbours.index_keys(n, got, settings).tolist()]
            met += sum(k in v for row in neighbours.index_keys(sample, got, settings).tolist() for k, v in zip(row, visited, strict=True))
        assert np.mean(found) == pytest.approx(recall) and recall >= settings.recall
        assert met / 20 / 500 == pytest.approx(share)
        shares.append(share)
    assert shares[1] < 0.3 * shares[0]
    # One table's perturbed cells are in the order of the summed squared distances to the borders.
    sets = neighbours.perturbations(np.array([0.1, 0.45, 0.7]), 27)
    cost = [sum(((1 - p) if step > 0 else p) ** 2 for f, step in chosen for p in [(0.1, 0.45, 0.7)[f]]) for chosen in sets]
    assert len(sets) == 27 and cost == sorted(cost)


def test_queries_of_a_crowded_bucket_are_dealt(spark):
    rows = spark.range(1200).selectExpr("id cid", "array(1D * id, 1D) v", "array(7L, 1000 + id) keys")
    asked = rows.filter("cid < 900")
    got = neighbours.dealt(rows, asked, neighbours.Settings(block=200, queries=100)).filter("key = 7")
    groups = got.groupBy("key", "part", "turn").pivot("asks", [0, 1]).count().collect()
    assert len(groups) == 6 * 9 and max(g["0"] for g in groups) < 300 and max(g["1"] for g in groups) < 160
    pairs = got.filter("asks = 0").select("part", "turn", "cid").join(
        got.filter("asks = 1").selectExpr("part", "turn", "cid q"), ["part", "turn"])
    assert pairs.count() == pairs.select("cid", "q").distinct().count() == 1200 * 900


def test_queries_are_compared_in_turns():
    import tracemalloc

    random_ = np.random.default_rng(6)
    data, asked = random_.normal(size=(2000, 4)), random_.normal(size=(5000, 4))
    tracemalloc.start()
    got = list(neighbours.nearest_in(data, np.arange(2000), asked, 3))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30_000_000  # one matrix of all pairs has 80 MB
    assert all((got[i][0] == np.argsort(-(data @ asked[i]))[:3]).all() for i in range(0, 5000, 500))


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 128, 1000])
def test_language_learns_from_whole_texts(size):
    text = random.Random(8).randbytes(size)
    got = list(language.windows(text, language.Settings(steps=64)))
    assert {len(w) for w in got} == {64} and len(got) == max(1, -(-size // 64))
    rest = size - 64 * (len(got) - 1)
    assert b"".join(got[:-1]) + (got[-1][-rest:] if len(got) > 1 else got[0][:size]) == text


def test_classifiers(spark):
    rows = [(k, f"{words(k, 30)} {'grob' if k % 3 == 0 else ''} {words(k + 999, 9)}", "de" if k % 2 else "en") for k in range(300)]
    rows = [(k, t.replace("a", "ü") if lang == "de" else t, lang) for k, t, lang in rows] + [(900, None, None), (901, "", "de"), (902, "12 !", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 3 = 0 as int) toxic").filter("doc_id < 300")
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(got) == 303 and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 300]
    assert held and np.mean([(r["score"] >= 0.5) == (r["doc_id"] % 3 == 0) for r in held]) > 0.9
    named = {r["doc_id"]: r for r in language.predict(docs, language.fit(docs)).collect()}
    assert all(named[k]["lang_pred"] == "und" for k in (900, 901, 902))
    assert np.mean([named[k]["lang_pred"] == ("de" if k % 2 else "en") for k in range(300) if named[k]["held_out"]]) > 0.95
    none = docs.limit(0)
    assert toxicity.score(docs, toxicity.fit(none, labels)).count() == 303
    assert language.predict(docs, language.fit(none)).filter("lang_pred <> 'und'").count() == 0
