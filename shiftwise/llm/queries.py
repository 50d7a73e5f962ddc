"""The operators on their given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftwise.llm import (
    exact_dedup,
    importance,
    licenses,
    line_templates,
    main_text,
    mixing,
    packing,
    quality,
    sharding,
    simhash,
    turn_repair,
    unigram_counts,
    url_lists,
)
from shiftwise.llm.common import read_table


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def op1_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_documents(spark, sf_dir))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir), shingle=3, distance=3)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_documents(_documents(spark, sf_dir))
    return found.withColumn("n_spans", F.size("spans").cast("long")).drop("spans")


def op4_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")))


def op5_streaming_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_documents(spark, sf_dir)).select(
        "doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256")
    )


def op6_risk_controlled_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_documents(spark, sf_dir), read_table(spark, sf_dir, "labels"))


def op7_temporal_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures, entries = url_lists.reported(read_table(spark, sf_dir, "pages"))
    return url_lists.evaluate(captures, entries).select(
        F.col("id").alias("page_id"),
        F.to_date("fetched").alias("fetched"),
        "blocked",
        "n_active",
        "entry_key",
        F.to_date("valid_from").alias("valid_from"),
    )


def op8_soft_membership_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(_documents(spark, sf_dir), read_table(spark, sf_dir, "labels"))


def op9_unigram_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram_counts.count_tokens(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op10_line_template_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.drop_lines(_documents(spark, sf_dir), **line_templates.WHOLE).select(
        "doc_id", "n_lines", "n_dropped", F.crc32("text").alias("rest_crc32")
    )


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))


def op12_line_block_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(read_table(spark, sf_dir, "pages"))


def op13_hirschberg_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair(read_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_hash_tree_shards,
        op2_simhash_near_dedup,
        op3_license_scan,
        op4_retrieval_packing,
        op5_streaming_exact_dedup,
        op6_risk_controlled_quality,
        op7_temporal_url_lists,
        op8_soft_membership_mixing,
        op9_unigram_token_counts,
        op10_line_template_dedup,
        op11_importance_resampling,
        op12_line_block_main_text,
        op13_hirschberg_turn_repair,
    )
} | {"pipeline": corpus_pipeline.run}

_STEPS = ", ".join(f"({i}, {', '.join(str(c) for c in step.values())})" for i, step in enumerate(quality.path()))
_REJECTED = "symbols > c_symbols OR repeats > c_repeats OR lines > c_lines OR long_words > c_long OR short_words > c_short OR capitals > c_capitals"

ORACLE: dict[str, str] = {
    "op6_risk_controlled_quality": rf"""
        WITH texts AS (SELECT row_number() OVER () AS row_no, doc_id, lang, coalesce(text, '') AS text FROM documents),
        split AS (
            SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
                   list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS own_lines
            FROM texts),
        windows AS (
            SELECT row_no, i, words[i:i + 4] AS win FROM (SELECT row_no, words, unnest(range(1, len(words) - 3)) AS i FROM split)),
        again AS (SELECT row_no, i FROM windows QUALIFY count(*) OVER (PARTITION BY row_no, win) > 1),
        covered AS (SELECT row_no, count(DISTINCT i + k) AS n_repeat_words FROM again, range(5) AS t(k) GROUP BY row_no),
        counts AS (
            SELECT row_no, doc_id, lang, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
                   length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
                   length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_capitals,
                   len(own_lines) AS n_lines, len(own_lines) - len(list_distinct(own_lines)) AS n_dup_lines,
                   coalesce(n_repeat_words, 0) AS n_repeat_words
            FROM split LEFT JOIN covered USING (row_no)),
        scores AS (
            SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
                   n_symbols / greatest(n_words, 1)::DOUBLE AS symbols, n_repeat_words / greatest(n_words, 1)::DOUBLE AS repeats,
                   n_dup_lines / greatest(n_lines, 1)::DOUBLE AS lines, word_chars / greatest(n_words, 1)::DOUBLE AS long_words,
                   -word_chars / greatest(n_words, 1)::DOUBLE AS short_words, n_capitals / greatest(word_chars, 1)::DOUBLE AS capitals
            FROM counts),
        steps(step, c_symbols, c_repeats, c_lines, c_long, c_short, c_capitals) AS (VALUES {_STEPS}),
        good AS (
            SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
        tried AS (
            SELECT lang, step, count(*) AS n, count(*) FILTER ({_REJECTED}) AS k
            FROM scores JOIN good USING (doc_id), steps WHERE NOT base_failed GROUP BY lang, step),
        tails AS (
            SELECT *, CASE WHEN k >= n * 0.01 THEN 1 ELSE list_sum(list_transform(range(k + 1), lambda i:
                       exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.01) + (n - i) * ln(0.99)))) END AS p
            FROM tried),
        sizes AS (SELECT lang, row_number() OVER (ORDER BY any_value(n) DESC, lang NULLS FIRST) AS place, any_value(n) AS n FROM tails GROUP BY lang),
        able AS (SELECT coalesce(max(place) FILTER (n >= ln(0.05 / place) / ln(0.99)), 0) AS m FROM sizes),
        walks AS (
            SELECT t.lang, max(p) AS worst, list(p ORDER BY step) AS ps, any_value(m) AS m,
                   row_number() OVER (ORDER BY max(p), t.lang NULLS FIRST) AS i
            FROM tails t JOIN sizes s ON t.lang IS NOT DISTINCT FROM s.lang, able WHERE place <= m GROUP BY t.lang),
        ended AS (SELECT coalesce(min(i) FILTER (worst > 0.05 / (m - i + 1)) - 1, count(*)) AS done FROM walks),
        passed AS (
            SELECT lang, CASE WHEN i <= done THEN len(ps) ELSE coalesce(
                       list_min(list_filter(range(len(ps)), lambda x: ps[x + 1] > 0.05 / greatest(m - done, 1))), len(ps)) END AS passed
            FROM walks, ended)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND NOT coalesce({_REJECTED}, false) AS kept
        FROM scores LEFT JOIN (SELECT lang AS of_lang, steps.* FROM passed JOIN steps ON step = passed - 1) ON lang IS NOT DISTINCT FROM of_lang""",
    "op5_streaming_exact_dedup": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        groups AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(text) AS text_sha256
        FROM t JOIN groups USING (text)""",
    "op7_temporal_url_lists": r"""
        WITH parts AS (
            SELECT page_id, url, DATE '2024-01-01' + CAST((page_id % 366 + 366) % 366 AS INTEGER) AS day,
                   contains(html, '%%%') AS stray,
                   regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1) AS authority,
                   regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/+([^/?#]*)', 1) AS step
            FROM pages),
        places AS (
            SELECT *, nullif(regexp_replace(lower(regexp_replace(regexp_replace(authority, '^.*@', ''), ':[0-9]*$', '')), '\.+$', ''), '') AS host
            FROM parts),
        entries AS (
            SELECT host AS key, day, 2 AS strength FROM places WHERE stray
            UNION ALL SELECT host, day + 30, 0 FROM places WHERE stray
            UNION ALL SELECT host || '/' || step, day, 1 FROM places WHERE contains(url, '#') AND step <> ''),
        days AS (
            SELECT key, day, max(strength) AS strength FROM entries
            WHERE key IS NOT NULL AND day IS NOT NULL GROUP BY key, day),
        changes AS (
            SELECT key, day, strength FROM days
            QUALIFY strength IS DISTINCT FROM lag(strength) OVER (PARTITION BY key ORDER BY day)),
        visits AS (
            SELECT DISTINCT url, day, host, step, string_split(host, '.') AS labels FROM places
            WHERE host IS NOT NULL AND day IS NOT NULL),
        keys AS (
            SELECT url, day, array_to_string(labels[i:], '.') AS key, len(labels) - i AS rank
            FROM (SELECT url, day, labels, unnest(range(1, len(labels) + 1)) AS i FROM visits)
            UNION ALL SELECT url, day, host || '/' || step, 1000 FROM visits WHERE step <> ''),
        best AS (
            SELECT k.url, k.day, count(*) AS n_active, arg_max(c.strength, k.rank) = 2 AS blocked,
                   arg_max(c.key, k.rank) AS entry_key, arg_max(c.day, k.rank) AS valid_from
            FROM keys k ASOF JOIN changes c ON k.key = c.key AND k.day >= c.day
            WHERE c.strength > 0 GROUP BY k.url, k.day)
        SELECT p.page_id, p.day AS fetched, coalesce(b.blocked, false) AS blocked,
               coalesce(b.n_active, 0) AS n_active, b.entry_key, b.valid_from
        FROM parts p LEFT JOIN best b ON p.url = b.url AND p.day = b.day""",
    "op11_importance_resampling": r"""
        WITH texts AS (
            SELECT doc_id, NULL AS item_id, text FROM documents UNION ALL SELECT NULL, item_id, text FROM benchmark),
        words AS (
            SELECT doc_id, item_id IS NULL AS raw, row_number() OVER () AS row_no,
                   coalesce(regexp_extract_all(
                       translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words
            FROM texts),
        crc_table AS (
            SELECT list(list_reduce(range(8), lambda c, n: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)
                        ORDER BY i) AS t
            FROM range(256) AS r(i)),
        vocabulary AS (SELECT DISTINCT unnest(words) AS word FROM words),
        coded AS (
            SELECT word, list_transform(range(strlen(word)), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT) AS bytes
            FROM vocabulary),
        buckets AS (
            SELECT word, xor(list_reduce(bytes, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket
            FROM coded, crc_table),
        features AS (
            SELECT row_no, raw, bucket FROM (SELECT row_no, raw, unnest(words) AS word FROM words) JOIN buckets USING (word)),
        counts AS (SELECT bucket, count(*) FILTER (raw) AS s, count(*) FILTER (NOT raw) AS t FROM features GROUP BY bucket),
        totals AS (SELECT coalesce(sum(s), 0) AS all_s, coalesce(sum(t), 0) AS all_t FROM counts),
        gains AS (
            SELECT bucket, CAST(floor(1000 * ln(((t + 1)::DOUBLE * (all_s + 10000)::DOUBLE)
                                                / ((s + 1)::DOUBLE * (all_t + 10000)::DOUBLE))) AS BIGINT) AS gain
            FROM counts, totals),
        sums AS (SELECT row_no, sum(gain)::BIGINT AS total, count(*) AS n FROM features JOIN gains USING (bucket) WHERE raw GROUP BY row_no),
        weights AS (
            SELECT doc_id, len(words) AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0) AS weight,
                   ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
            FROM words LEFT JOIN sums USING (row_no) WHERE raw),
        scores AS (
            SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
            FROM weights),
        able AS (
            SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place,
                   count(*) FILTER (n_features >= 20) OVER () AS n
            FROM scores)
        SELECT doc_id, n_features, weight, score,
               CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank
        FROM able""",
}
