"""The registered queries of this subpackage: each on its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table, tokenizer_path
from .decontamination import contamination
from .filter_audit import filter_interactions
from .hamming_search import embedding_search
from .language_id import language_ids
from .language_model import language_model_scores
from .mixing import mixing_report
from .near_dedup import near_duplicate_report
from .piece_codec import codec_digests
from .substring_dedup import repeated_units
from .token_alignment import alignment_report
from .token_files import token_id_output
from .token_rollup import rollup_history
from .toxicity import toxicity_scores


def op1_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_id_output(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_report(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup_history(table(spark, sf_dir, "documents"))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_search(table(spark, sf_dir, "embeddings"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_units(table(spark, sf_dir, "documents"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_report(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model_scores(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_ids(table(spark, sf_dir, "documents"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    return alignment_report(table(spark, sf_dir, "documents"), first, second)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec_digests(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
    ordered = sorted(found.items(), key=lambda kv: int(kv[0][2:].split("_")[0]))
    return dict(ordered) | {"pipeline": _pipeline}


_MIXING_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5(text) AS digest,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), sums AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
              WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM sums
), caps AS (
  SELECT *, source_size * 2.0::DOUBLE AS most, source_size * 2.0::DOUBLE / weight AS ratio,
         sum(source_size) OVER () * 1.5::DOUBLE AS total, sum(weight) OVER () AS weights
  FROM weighed
), levels AS (
  SELECT *, row_number() OVER (ORDER BY ratio, source NULLS LAST) AS place,
         (total - coalesce(sum(most) OVER before, 0.0::DOUBLE))
            / (weights - coalesce(sum(weight) OVER before, 0.0::DOUBLE)) AS own_level
  FROM caps
  WINDOW before AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT arg_min(own_level, place) AS level FROM levels WHERE own_level < ratio
), targets AS (
  SELECT source, source_size, CASE WHEN level IS NULL THEN most ELSE least(most, weight * level) END AS target
  FROM levels, level
), rated AS (
  SELECT doc_id, digest, size, source_size, target,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
), copied AS (
  SELECT *, CAST(floor(rate) AS BIGINT) + CAST(
           CAST(('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(digest, '') || ':'), 1, 8)) AS BIGINT)
           / 4294967296.0::DOUBLE < rate - floor(rate) AS BIGINT) AS copies
  FROM rated
)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM copied
"""

_CONTAMINATION_SQL = r"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), doc_words AS (
  SELECT row_number() OVER () AS r, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item_words WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc_words, lengths WHERE len(w) >= n)
), found AS (
  SELECT g.r, g.n, g.i, windows.item_id FROM grams g JOIN windows ON g.n = windows.n AND g.gram = windows.gram
), hits AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM found) GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, sha256(string_agg(id, ',' ORDER BY id)) AS digest
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, coalesce(digest, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hits USING (r) LEFT JOIN items USING (r)
"""


_ROLLUP_SQL = r"""
WITH counted AS (
  SELECT doc_id, source, lang,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS w,
         coalesce(len(regexp_extract_all(
           text, '[A-Za-z0-9\x{80}-\x{10FFFF}]+|[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]')), 0) AS p,
         CASE WHEN text IS NULL THEN false
              ELSE doc_id > min(doc_id) OVER (PARTITION BY text) END AS repeated
  FROM documents
)
SELECT source, lang, tokenizer, count(*) AS n_docs, CAST(sum(tokens) AS BIGINT) AS n_tokens
FROM (
  SELECT source, lang, CASE WHEN lang = 'en' THEN 'words-1' ELSE 'pieces-2' END AS tokenizer,
         CASE WHEN lang = 'en' AND p <= 2 * w THEN w ELSE p END AS tokens
  FROM counted WHERE NOT coalesce(repeated, false)
)
GROUP BY source, lang, tokenizer
"""

_FILTER_SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
words AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS earliest FROM texts),
known AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
failed AS (
  SELECT part, CASE WHEN len(w) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
      + CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t) THEN 4 ELSE 0 END
      + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > earliest THEN 16 ELSE 0 END AS m,
    coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM words LEFT JOIN known USING (doc_id)
), cells AS (
  SELECT part, m, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM failed GROUP BY part, m
), letters(f) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), steps AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, 1 << (ascii(filter_order[step]) - 65) AS bit,
         CAST(coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65))), 0) AS INTEGER) AS before
  FROM orders, range(1, 6) AS s(step)
), counted AS (
  SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (m & (before | bit) = 0), 0) AS kept,
    coalesce(sum(n) FILTER (m & bit <> 0 AND m & before = 0), 0) AS removed,
    coalesce(sum(n) FILTER (m & bit <> 0 AND m & before <> 0), 0) AS redundant, coalesce(sum(n) FILTER (m = bit), 0) AS unique_fails,
    coalesce(sum(good) FILTER (m & bit <> 0 AND m & before = 0), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (m & bit <> 0 AND m & before = 0), 0) AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM counted
"""

_TOP_K_SQL = r"""
WITH codes AS (
  SELECT DISTINCT vec_id AS id,
         array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '')::BIT AS code
  FROM embeddings WHERE len(embedding) = 64
), pairs AS (
  SELECT q.id AS query_id, c.id AS vec_id, bit_count(xor(q.code, c.code)) AS distance
  FROM codes q JOIN codes c ON q.id % 50 = 0 AND q.id <> c.id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(distance AS BIGINT) AS distance
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM pairs)
WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_mixing": _MIXING_SQL,
        "op4_token_counts": _ROLLUP_SQL,
        "op5_exact_top_k": _TOP_K_SQL,
        "op10_benchmark_decontamination": _CONTAMINATION_SQL,
        "op12_filter_audit": _FILTER_SQL,
    }
