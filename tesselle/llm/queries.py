"""The queries of this folder, and the SQL they are held against where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, exact, langid, lines, omh, packing, pieces, simhash, suffix, toxicity
from .common import table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.removal_digests(table(spark, sf_dir, "documents"))


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return omh.neighbour_fingerprints(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_digests(table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.removal_digests(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.group_copies(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), _tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat": op1_chat,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_order_minhash": op3_order_minhash,
    "op4_toxicity": op4_toxicity,
    "op5_simhash": op5_simhash,
    "op6_language": op6_language,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_line_dedup": op8_line_dedup,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_packing": op10_packing,
}

ORACLES: dict[str, str] = {
    # Turn numbers are unique within a conversation of the test tables, so ties need no order here.
    "op1_chat": r"""
        WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
        p AS (
            SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
                   md5(string_agg(md5(role) || md5(text), '' ) OVER w) AS h
            FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)),
        k AS (
            SELECT min(conv_id) AS conv_id, count(*) AS n_copies FROM p
            WHERE pos = n AND (pos, h) NOT IN (SELECT (pos, h) FROM p WHERE pos < n) GROUP BY pos, h)
        SELECT conv_id, CAST((pos - 1) // 512 AS INTEGER) AS segment, CAST(any_value(n + 511) // 512 AS INTEGER) AS n_segments,
               any_value(n) AS n_turns, any_value(n_copies) AS n_copies,
               string_agg('<|im_start|>' || replace(replace(role, '<|im_start|>', '<im_start>'), '<|im_end|>', '<im_end>') || chr(10)
                          || replace(replace(text, '<|im_start|>', '<im_start>'), '<|im_end|>', '<im_end>') || '<|im_end|>' || chr(10), '' ORDER BY pos) AS text
        FROM p JOIN k USING (conv_id) GROUP BY conv_id, (pos - 1) // 512""",
    # Bytes as pairs of hexadecimal digits; windows by their MD5.
    "op2_suffix_dedup": r"""
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        b AS (SELECT doc_id, o, substr(h, 2 * o + 1, 2 * 399) AS part FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 199, 200)) AS o FROM d)),
        w AS (SELECT doc_id, o + i AS i, md5(substr(part, 2 * i + 1, 400)) AS k FROM (SELECT *, unnest(range(0, length(part) // 2 - 199)) AS i FROM b)),
        twice AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
        hit AS (SELECT doc_id, i FROM w SEMI JOIN twice USING (k)),
        begun AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS b FROM hit),
        spans AS (
            SELECT doc_id, min(i) AS a, max(i) + 200 AS z
            FROM (SELECT *, sum(b) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM begun) GROUP BY doc_id, span),
        gaps AS (SELECT doc_id, a, z, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS from_ FROM spans),
        cut AS (
            SELECT doc_id, string_agg(substr(h, 2 * from_ + 1, 2 * (a - from_)), '' ORDER BY a) AS head, max(z) AS z, sum(z - a) AS n, count(*) AS c
            FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(c, 0) AS BIGINT) AS n_spans,
               sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(z, 0) + 1))) AS kept_sha256
        FROM d LEFT JOIN cut USING (doc_id)""",
    "op8_line_dedup": r"""
        WITH l AS (
            SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        w AS (
            SELECT doc_id, s, lines[s:s + 1] AS win FROM (SELECT *, unnest(range(1, len(lines))) AS s FROM l)),
        f AS (SELECT doc_id, s FROM (SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id, s) AS nth FROM w) WHERE nth > 1),
        gone AS (SELECT DISTINCT doc_id, i FROM (SELECT doc_id, unnest([s, s + 1]) AS i FROM f)),
        every AS (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS i, unnest(lines) AS line FROM l),
        marked AS (SELECT e.*, g.i IS NOT NULL AS cut FROM every e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i),
        steps AS (SELECT *, cut AND NOT coalesce(lag(cut) OVER (PARTITION BY doc_id ORDER BY i), false) AS begins FROM marked)
        SELECT doc_id, CAST(count(*) AS INTEGER) AS n_lines, CAST(count(*) FILTER (cut) AS INTEGER) AS n_removed,
               CAST(count(*) FILTER (begins) AS INTEGER) AS n_runs,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT cut), '')) AS kept_sha256
        FROM steps GROUP BY doc_id""",
    "op9_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
            FROM documents)
        SELECT doc_id,
               min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
               count(*) OVER (PARTITION BY text_sha256) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept,
               text_sha256
        FROM d""",
}
