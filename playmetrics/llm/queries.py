"""The registered queries of this subpackage, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playmetrics.llm import (
    alignment,
    extraction,
    grid,
    language,
    neighbours,
    packing,
    quality,
    sentencepieces,
    similar,
    suffixes,
    toxicity,
    trie,
    warc,
)
from playmetrics.llm.common import read
from playmetrics.operators.sizing import scratch_path

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str) -> str:
    """The path of a public tokenizer file, which every executor has at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write(warc.roles(read(spark, sf_dir, "pages")), path)
    records = warc.load(spark, path, payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.join(read(spark, sf_dir, "documents"))


def op4_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(read(spark, sf_dir, "pages"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return language.predict(docs, language.fit(docs))


def op7_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = vocabulary("piece_bpe_32k.model")
    found = sentencepieces.decode(sentencepieces.encode(read(spark, sf_dir, "documents"), model), model)
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_ids"), "n_chunks", "ids_crc32",
        F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"), "ids",
    )


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.deduplicate(read(spark, sf_dir, "documents"), kept=None)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read(spark, sf_dir, "documents")).select(
        "__row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op11_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.join(read(spark, sf_dir, "embeddings"))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(read(spark, sf_dir, "conversations"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
    return alignment.align(read(spark, sf_dir, "documents"), a, b)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_warc, op2_neighbours, op3_similar, op4_extraction, op5_toxicity, op6_language, op7_sentencepieces,
        op8_suffixes, op9_quality, op10_packing, op11_grid, op12_trie, op13_alignment,
    )
}

_STOP_LIST = ", ".join(f"'{w}'" for w in sorted(set(quality.STOP_WORDS)))

SQL: dict[str, str] = {
    "op1_warc": """
        WITH p AS (
            SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
            FROM pages
        ), g AS (
            SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes)
                ELSE page_id END AS first_of
            FROM p
        )
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_of = page_id THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN first_of <> page_id THEN first_of END AS refers_to
        FROM g
    """,
    "op9_quality": rf"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS t,
                regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                [x for x in string_split(coalesce(text, ''), chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS l
            FROM documents
        ), positions AS (
            SELECT doc_id, i, array_to_string(list_slice(w, i, i + 4), ' ') AS g
            FROM d, unnest(range(1, len(w) - 3)) AS r(i)
        ), counted AS (
            SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM positions
        ), spread AS (
            SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), i - 5) AS before FROM counted WHERE n > 1
        ), repeats AS (
            SELECT doc_id, CAST(sum(least(5, i - before)) AS BIGINT) AS n FROM spread GROUP BY doc_id
        ), counts AS (
            SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
                CAST(coalesce(list_sum([length(x) for x in w]), 0) AS BIGINT) AS word_chars,
                CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
                CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, len(l) AS n_lines,
                len([x for x in w if lower(x) IN ({_STOP_LIST})]) AS n_stop_words,
                coalesce(r.n, 0) AS n_repeat_words
            FROM d LEFT JOIN repeats r USING (doc_id)
        ), base AS (
            SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
            CASE WHEN base_failed THEN false ELSE
                CAST(word_chars AS DOUBLE) / n_words BETWEEN 2.0 AND 15.0 AND CAST(n_symbols AS DOUBLE) / n_words <= 0.3
                AND CAST(n_dup_lines AS DOUBLE) / n_lines <= 0.5 AND CAST(n_stop_words + 1 AS DOUBLE) / n_words >= 0.03
            END AS kept
        FROM base
    """,
    "op11_grid": """
        WITH RECURSIVE usable AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE label IS NOT NULL AND len(embedding) > 0
                AND list_bool_and([x IS NOT NULL AND isfinite(x) for x in embedding])
                AND list_bool_or([x <> 0 for x in embedding])
        ), links AS (
            SELECT a.vec_id AS u, b.vec_id AS v FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id
            WHERE CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= 0.98 ELSE false END
        ), reached AS (
            SELECT vec_id, vec_id AS other FROM embeddings
            UNION
            SELECT r.vec_id, l.v FROM reached r JOIN links l ON l.u = r.other
        ), parts AS (
            SELECT vec_id, min(other) AS component_id FROM reached GROUP BY vec_id
        )
        SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, p.component_id, e.vec_id = p.component_id AS kept
        FROM embeddings e JOIN parts p ON p.vec_id = e.vec_id
            LEFT JOIN (SELECT u, count(*) AS n_links FROM links GROUP BY u) n ON n.u = e.vec_id
    """,
    "op12_trie": """
        WITH own AS (
            SELECT conv_id AS c, turn, coalesce(text, '') AS text,
                sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS key
            FROM conversations WHERE conv_id IS NOT NULL
        ), numbered AS (
            SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, key) AS k FROM own
        ), convs AS (
            -- CRC-32 bit by bit: after each byte of the id, eight steps (-1)
            SELECT c, c - c % 100 AS base, xor(4294967295, list_reduce(
                list_prepend(4294967295, flatten([list_prepend(ord(x), [-1, -1, -1, -1, -1, -1, -1, -1]) for x in string_split(CAST(c AS VARCHAR), '')])),
                lambda r, o: CASE WHEN o >= 0 THEN xor(CAST(r AS BIGINT), CAST(o AS BIGINT))
                    ELSE xor(CAST(r AS BIGINT) >> 1, 3988292384 * (CAST(r AS BIGINT) & 1)) END)) % 6 AS h
            FROM (SELECT DISTINCT c FROM numbered)
        ), turns AS (
            SELECT v.c, 0 AS part, k, key, text FROM convs v JOIN numbered n ON n.c = v.base AND n.k <= v.h
            UNION ALL
            SELECT v.c, 1 AS part, k, key, text FROM convs v JOIN numbered n ON n.c = v.c AND n.k > v.h
        ), steps AS (
            SELECT c, row_number() OVER w AS d, string_agg(key, '') OVER w AS p, length(text) AS chars FROM turns
            WINDOW w AS (PARTITION BY c ORDER BY part, k)
            UNION ALL
            SELECT c, 0, '', 0 FROM convs
        ), sized AS (
            SELECT *, max(d) OVER (PARTITION BY c) AS size FROM steps
        ), nodes AS (
            SELECT p, d, left(p, 64 * (d - 1)) AS q, min(c) AS conv_id, count(*) AS n, (count(*) - 1) * any_value(chars) AS saved,
                sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE d = size), '')) AS ends
            FROM sized GROUP BY p, d
        ), children AS (
            SELECT q, count(*) AS n FROM nodes WHERE d > 0 GROUP BY q
        ), sums AS (
            SELECT left(x.p, 64 * i) AS p, count(*) FILTER (WHERE k.q IS NULL) AS n_leaves, sum(x.saved) AS saved
            FROM nodes x LEFT JOIN children k ON k.q = x.p, unnest(range(0, x.d + 1)) AS r(i) GROUP BY 1
        )
        SELECT x.conv_id, x.d AS depth, u.conv_id AS parent_conv_id, x.n AS n_convs, coalesce(k.n, 0) AS n_children,
            s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, x.ends AS ends_sha256
        FROM nodes x JOIN sums s ON s.p = x.p LEFT JOIN children k ON k.q = x.p
            LEFT JOIN nodes u ON x.d > 0 AND u.p = x.q AND u.d = x.d - 1
    """,
}
