"""The alignment of two tokenizers against a plain version."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest

from playmetrics.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")

ODD = [
    None, "", " ", "  ", "x", "a b", "a  b", "a b ", " a", "\n", "a\n b", "x\n \ny", "x \ny", "\ta\t b \t c", "it's 5's I'LL",
    " <s> hi </s> <0x41> <unk>", "<|endoftext|> z", "日本 語　x y", "é é ﬁ ﬂ", "\x00 a", "a \x1c b", "👩‍👩‍👧 x", "▁a ▁b a▁b",
    "a​ b", "x" * 3000 + " y z", " " * 900 + "x", "a b", "a b", "the cat sat on the mat " * 40,
]


def plain(texts):
    """Per text the tokens by the libraries, spans compared one by one."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a_tool, b_tool = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a_tool.encode_special_tokens = True
    table = alignment.byte_table()

    def spans(tokens, ids):
        out, at = [], 0
        for t, i in zip(tokens, ids, strict=True):
            out.append((at, at + len(t), i))
            at += len(t)
        return out

    def b_bytes(i):
        piece = b_tool.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b_tool.is_byte(i) else piece.replace("▁", " ").encode()

    done = []
    for text in texts:
        raw = f" {text}".encode()
        a = a_tool.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = b_tool.encode(text) if text else []
        a_tokens = [bytes(table[c] for c in a_tool.id_to_token(i)) for i in a]
        b_tokens = [b_bytes(i) for i in b]
        if not text or b"".join(a_tokens) != raw or b"".join(b_tokens) != raw:
            done.append(None)
            continue
        a, b = spans(a_tokens, a), spans(b_tokens, b)
        links = [(x[2], y[2]) for x in a for y in b if x[0] < y[1] and y[0] < x[1]]
        groups, begin = [], 0
        for end in sorted({x[1] for x in a} & {y[1] for y in b}):
            sides = [",".join(str(t[2]) for t in side if begin < t[1] <= end) for side in (a, b)]
            groups.append("|".join(sides))
            begin = end
        done.append((len(a), len(b), groups, links))
    held = Counter(pair for x in done if x for pair in set(x[3]))
    most = defaultdict(int)
    for (i, _), n in held.items():
        most[i] = max(most[i], n)
    rows = []
    for x in done:
        if x is None:
            rows.append((0, 0, 0, 0, 0, 0, "", ""))
            continue
        best = sum(held[pair] == most[pair[0]] for pair in x[3])
        text = ";".join(x[2])
        digest = hashlib.sha256(text.encode()).hexdigest()
        rows.append((x[0], x[1], len(x[2]), len(x[3]), best, sum(held[p] for p in x[3]), digest, text))
    return rows


@pytest.fixture(scope="module")
def expected():
    return plain(ODD)


def rows_of(spark, **options):
    table = [(i, t, "clash", 1) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(table, "doc_id long, text string, pairs string, n_a int")
    found = alignment.align(docs, A, B, groups=True, **options)
    assert found.columns == ["doc_id", *alignment.MEASURES, "groups_sha256", "groups"]
    return [tuple(r)[1:] for r in sorted(found.collect())]


def test_same_as_plain(spark, expected):
    assert rows_of(spark) == expected


def test_counts_joined_when_their_table_is_large(spark, expected):
    assert rows_of(spark, table_bytes=0) == expected


@pytest.mark.parametrize("segment, store", [(7, 3), (1 << 18, 2)])
def test_segments_and_small_stores(monkeypatch, expected, segment, store):
    monkeypatch.setattr(alignment, "SEGMENT", segment)
    monkeypatch.setattr(alignment, "BATCH_CHARS", 20)
    monkeypatch.setattr(alignment, "KEPT_WORDS", store)
    tool = alignment.Aligner(A, B)
    found = tool.measures([t for t in ODD if t], True)
    wanted = [e for t, e in zip(ODD, expected, strict=True) if t]
    for x, want in zip(found, wanted, strict=True):
        assert ("" if x is None else x["groups"]) == want[7]
        assert (0 if x is None else x["n_links"]) == want[3]


def test_quicker_library_gives_the_same_ids():
    tool = alignment.Aligner(A, B)
    assert tool.quick is not None and tool.cuts
    for text in (t for t in ODD if t):
        assert tool.quick.encode_ordinary(text) == tool.a.encode(text, add_special_tokens=False).ids


def test_hot_text_and_empty_table(spark):
    docs = spark.createDataFrame([(i, "a hot text") for i in range(300)] + [(300, "a b")], "doc_id long, text string")
    found = alignment.align(docs, A, B).collect()
    assert len(found) == 301
    hot = {tuple(r)[1:] for r in found if r.doc_id < 300}
    assert len(hot) == 1 and hot.pop()[5] % 300 in (1, 0)
    assert alignment.align(docs.limit(0), A, B).collect() == []
