"""The thin queries over ``documents``, one for each operator of this subpackage, and their SQL where SQL has it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidewrack.llm import bpe, conversations, exact, language, lines, manifest, mixing, ngrams, quality, secrets, simhash, substring, tokencount


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digests(_documents(spark, sf_dir))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.groups(_documents(spark, sf_dir))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_words, n_tokens."""
    return tokencount.token_counts(_documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model")).drop("text")


def op4_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(_documents(spark, sf_dir))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(_documents(spark, sf_dir))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(_documents(spark, sf_dir)).drop("row", "gone")


def op7_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.repeated_lines(_documents(spark, sf_dir))


def op8_suffix_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(_documents(spark, sf_dir))


def op9_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_ngram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.scores(_documents(spark, sf_dir))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.verified(_documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_token_counts": op3_token_counts,
    "op4_entropy_mixing": op4_entropy_mixing,
    "op5_language_id": op5_language_id,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_fuzzy_lines": op7_fuzzy_lines,
    "op8_suffix_quality": op8_suffix_quality,
    "op9_simhash_groups": op9_simhash_groups,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_ngram_scores": op12_ngram_scores,
    "op13_merkle_manifest": op13_merkle_manifest,
}

def _crc32(text: str) -> str:
    """DuckDB SQL for the CRC-32 of a decimal number's text: a shift register, eight steps a byte."""
    step = "xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END)"
    byte = f"list_reduce([xor(c, b)] || repeat([0::UBIGINT], 8), lambda x, z: {step})"
    codes = f"list_transform(range(1, length({text}) + 1), lambda k: ascii(substr({text}, k, 1))::UBIGINT)"
    return f"xor(list_reduce([4294967295::UBIGINT] || {codes}, lambda c, b: {byte}), 4294967295::UBIGINT)"


def _field(value: str) -> str:
    """DuckDB SQL for a field of a leaf."""
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(n_chars: str) -> str:
    return f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', n_chars, 'text')))})"


ORACLE_SQL: dict[str, str] = {
    "op11_conversation_trie": f"""
        WITH turns AS (
            SELECT conv_id, turn, length(coalesce(text, '')) AS chars, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest
            FROM conversations WHERE conv_id IS NOT NULL
        ), own AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS place FROM turns
        ), convs AS (
            SELECT conv_id, conv_id - conv_id % 100 AS base, {_crc32("CAST(conv_id AS VARCHAR)")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM turns)
        ), rebuilt AS (
            SELECT c.conv_id, 0 AS part, o.place, o.digest, o.chars FROM convs c JOIN own o ON o.conv_id = c.base AND o.place <= c.h
            UNION ALL SELECT c.conv_id, 1, o.place, o.digest, o.chars FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.place > c.h
        ), placed AS (
            SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, place) AS depth, digest, chars FROM rebuilt
        ), passed AS (
            SELECT conv_id, depth, string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY depth) AS name, chars FROM placed
            UNION ALL SELECT conv_id, 0, '', 0 FROM convs
        ), linked AS (
            SELECT *, lag(name) OVER w AS parent, lead(name) OVER w IS NULL AS ended FROM passed WINDOW w AS (PARTITION BY conv_id ORDER BY depth)
        ), nodes AS (
            SELECT name, min(conv_id) AS conv_id, min(depth) AS depth, min(parent) AS parent, count(*) AS n_convs, (count(*) - 1) * min(chars) AS saved,
                   sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ended), '')) AS ends_sha256
            FROM linked GROUP BY name
        ), kids AS (
            SELECT parent AS name, count(*) AS n FROM nodes GROUP BY parent
        ), told AS (
            SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids USING (name)
        ), below AS (
            SELECT DISTINCT a.name AS top, b.name FROM passed a JOIN passed b ON a.conv_id = b.conv_id AND a.depth <= b.depth
        ), sums AS (
            SELECT top AS name, sum(saved) AS saved_tokens, count_if(n_children = 0) AS n_leaves FROM below JOIN told USING (name) GROUP BY top
        )
        SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
        FROM told n JOIN sums s USING (name) LEFT JOIN nodes p ON n.parent = p.name
    """,
    "op13_merkle_manifest": f"""
        WITH RECURSIVE digests AS (
            SELECT doc_id, lang, {_leaf("n_chars")} AS leaf, {_leaf(f"(n_chars + CASE WHEN {_crc32('CAST(doc_id AS VARCHAR)')} % 7 = 0 THEN 1 ELSE 0 END)")} AS seen FROM documents
        ), leaves AS (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM digests
        ), tree(lang, level, idx, n, node) AS (
            SELECT lang, 0, idx, n, leaf FROM leaves
            UNION ALL SELECT lang, level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY idx)) FROM tree WHERE n > 1 GROUP BY lang, level, n, idx // 2
        ), tops AS (
            SELECT lang, node, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM tree WHERE n = 1
        ), trunk(level, idx, n, node) AS (
            SELECT 0, idx, n, node FROM tops
            UNION ALL SELECT level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY idx)) FROM trunk WHERE n > 1 GROUP BY level, n, idx // 2
        ), steps AS (
            SELECT l.lang, l.idx, u.level AS step, l.idx >> u.level AS place, s.node AS other
            FROM leaves l JOIN (SELECT DISTINCT lang, level FROM tree WHERE n > 1) u ON l.lang IS NOT DISTINCT FROM u.lang
            LEFT JOIN tree s ON s.lang IS NOT DISTINCT FROM l.lang AND s.level = u.level AND s.idx = xor(l.idx >> u.level, 1)
            UNION ALL
            SELECT l.lang, l.idx, 100 + u.level, t.idx >> u.level, s.node
            FROM leaves l JOIN tops t ON l.lang IS NOT DISTINCT FROM t.lang CROSS JOIN (SELECT DISTINCT level FROM trunk WHERE n > 1) u
            LEFT JOIN trunk s ON s.level = u.level AND s.idx = xor(t.idx >> u.level, 1)
        ), paths AS (
            SELECT lang, idx, list({{'place': place, 'node': other}} ORDER BY step) AS path, sha256(coalesce(string_agg(other, '' ORDER BY step), '')) AS proof FROM steps GROUP BY lang, idx
        ), folded AS (
            SELECT l.doc_id, l.leaf, t.node AS subroot, (SELECT node FROM trunk WHERE n = 1) AS root, coalesce(p.proof, sha256('')) AS proof_sha256,
                   list_reduce([{{'place': 0::BIGINT, 'node': l.seen}}] || coalesce(p.path, []), lambda a, b: {{'place': 0::BIGINT, 'node': sha256(
                       CASE WHEN b.node IS NULL THEN a.node WHEN b.place % 2 = 1 THEN b.node || a.node ELSE a.node || b.node END)}}).node AS folded_root
            FROM leaves l JOIN tops t ON l.lang IS NOT DISTINCT FROM t.lang LEFT JOIN paths p ON p.lang IS NOT DISTINCT FROM l.lang AND p.idx = l.idx
        )
        SELECT *, folded_root = root AS verified FROM folded
    """,
    "op2_exact_dedup": r"""
        WITH keyed AS (
            SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
            FROM documents
        ), grouped AS (
            SELECT doc_id, text_sha256, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
                   count(*) OVER (PARTITION BY text_sha256) AS group_size
            FROM keyed
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM grouped
    """,
}
