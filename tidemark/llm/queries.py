"""The queries of this subpackage, each over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embeddings, fingerprints, minhash, mixing, packing, pii, quality, repetition, sharding, token_counts, tries, warc, whitening
from .common import scratch, table


def op1_zstd_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_disclosure_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op3_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op4_chosen_path_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op7_systematic_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


def op9_line_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op10_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = repetition.judge_repetition(table(spark, sf_dir, "documents"))
    names = {"words": "n_words", "word_chars": "word_chars", "symbols": "n_symbols", "dup_lines": "n_dup_lines", f"words_{repetition.WINDOW}": "n_repeat_words"}
    return judged.select("doc_id", *[F.col(c).alias(n) for c, n in names.items()], "base_failed", "kept", "broken")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.conversation_trie(table(spark, sf_dir, "conversations"))


def op13_lanczos_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_zstd_warc,
        op2_disclosure_pii,
        op3_feistel_sharding,
        op4_chosen_path_minhash,
        op5_prefix_token_counts,
        op6_scaled_sketch,
        op7_systematic_mixing,
        op8_cap_filters,
        op9_line_crf_quality,
        op10_best_two_fit,
        op11_repetition_coverage,
        op12_prefix_trie,
        op13_lanczos_whitening,
    )
}

ORACLES: dict[str, str] = {
    "op7_systematic_mixing": r"""
WITH docs AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
weighted AS (
  SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, source_size * 2.0::DOUBLE AS cap FROM sizes),
levels AS (
  SELECT *, ((SELECT sum(source_size) FROM weighted)::DOUBLE * 1.5 - coalesce((SELECT sum(b.cap) FROM weighted b WHERE b.cap / b.weight < a.cap / a.weight), 0))
    / ((SELECT sum(weight) FROM weighted)::DOUBLE - coalesce((SELECT sum(b.weight) FROM weighted b WHERE b.cap / b.weight < a.cap / a.weight), 0)) AS level
  FROM weighted a),
free AS (SELECT min_by(level, cap / weight) AS level FROM levels WHERE level * weight <= cap),
targets AS (
  SELECT source, source_size, CASE WHEN f.level IS NULL THEN cap ELSE least(cap, f.level * weight) END AS target,
    CASE WHEN source_size > 0 THEN least(2.0, (CASE WHEN f.level IS NULL THEN cap ELSE least(cap, f.level * weight) END) / source_size) ELSE 0 END AS e,
    ('0x' || substr(md5('mix:' || coalesce(source, chr(0) || 'null')), 1, 7))::BIGINT / 268435456.0::DOUBLE AS u
  FROM levels l, free f),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id NULLS FIRST) - 1 AS i FROM docs)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (size * (floor(e) + least(1, floor(u + (e - floor(e)) * (i + 1)) - floor(u + (e - floor(e)) * i))))::BIGINT AS taken
FROM ranked r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source
""",
    "op11_repetition_coverage": r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT unnest(range(5, 11)) AS n))),
twice AS (SELECT rid, n, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, n, g) AS c FROM grams) WHERE c > 1),
inside AS (SELECT DISTINCT rid, n, unnest(range(i, i + n)) AS p FROM twice),
covered AS (
  SELECT rid, n, count(*) AS words, sum(len(w[p])) AS chars FROM inside JOIN docs USING (rid) GROUP BY rid, n),
lines AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM docs),
equal AS (SELECT rid, line, count(*) AS c FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid, line),
by_lines AS (
  SELECT rid, sum(c - 1) AS dup_lines, sum((c - 1) * len(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) AS line_chars FROM equal GROUP BY rid),
counts AS (
  SELECT rid, doc_id, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars, len(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(dup_lines, 0) AS n_dup_lines, coalesce(line_chars, 0) AS line_chars,
    coalesce((SELECT words FROM covered c WHERE c.rid = d.rid AND n = 8), 0) AS n_repeat_words
  FROM docs d LEFT JOIN by_lines USING (rid)),
broken AS (
  SELECT rid, 'ngrams_' || n AS rule, n AS place FROM covered JOIN counts USING (rid) WHERE 100 * chars > 30 * word_chars
  UNION ALL SELECT rid, 'lines', 11 FROM counts WHERE 100 * line_chars > 30 * word_chars),
named AS (SELECT rid, string_agg(rule, ',' ORDER BY place) AS broken FROM broken GROUP BY rid)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND broken IS NULL AS kept, coalesce(broken, '') AS broken
FROM counts LEFT JOIN named USING (rid)
""",
    "op12_prefix_trie": r"""
WITH ranked AS (
  SELECT conv_id, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS t,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS r
  FROM conversations WHERE conv_id IS NOT NULL),
whole AS (
  SELECT conv_id, list(t ORDER BY r) AS turns,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % 4 AS h
  FROM ranked GROUP BY conv_id),
rebuilt AS (
  SELECT a.conv_id, list_concat(coalesce(b.turns[1:a.h], []), a.turns[a.h + 1:]) AS turns
  FROM whole a LEFT JOIN whole b ON b.conv_id = a.conv_id - a.conv_id % 20),
places AS (SELECT conv_id, len(turns) AS last, unnest(range(0, len(turns) + 1)) AS depth, turns FROM rebuilt),
prefixes AS (SELECT conv_id, last, depth, turns[1:depth] AS p FROM places),
nodes AS (
  SELECT p, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last = depth), '')) AS ends_sha256,
    (count(*) - 1) * CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(p[depth].text, '[^\x20\x09-\x0D]+')) END AS saved
  FROM prefixes GROUP BY p, depth),
children AS (SELECT p[1:depth - 1] AS p, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
weighed AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children c ON n.p = c.p AND n.depth = c.depth),
above AS (SELECT p, unnest(range(0, depth + 1)) AS up, saved, n_children FROM weighed),
totals AS (SELECT p[1:up] AS p, up AS depth, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM above GROUP BY ALL)
SELECT w.conv_id, w.depth::BIGINT AS depth, o.conv_id AS parent_conv_id, w.n_convs::BIGINT AS n_convs, w.n_children::BIGINT AS n_children,
  n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, w.ends_sha256
FROM weighed w JOIN totals t ON w.p = t.p AND w.depth = t.depth LEFT JOIN nodes o ON w.depth > 0 AND o.depth = w.depth - 1 AND o.p = w.p[1:w.depth - 1]
""",
}
