"""Registered queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, compaction, hnsw, merkle, mixing, mpegts, pfor, pii, quality, resample, secret_scan, simhash, substring
from .common import table

#: The key of the surrogates; a deployment passes its own.
PII_KEY = b"surrogate key of this deployment"


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file; it must exist on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_transport_stream": lambda s, d: mpegts.digest(table(s, d, "documents")),
        "op2_hnsw": lambda s, d: hnsw.digest(table(s, d, "embeddings")),
        "op3_substring_dedup": lambda s, d: substring.digest(table(s, d, "documents")),
        "op4_bpe": lambda s, d: bpe.encode_documents(table(s, d, "documents"), vocabulary("word_bpe_49k.json"), keep=False),
        "op5_quality": lambda s, d: quality.classify(table(s, d, "documents"), table(s, d, "labels")),
        "op6_compaction": lambda s, d: compaction.digest(table(s, d, "documents")),
        "op7_pfor_tokens": lambda s, d: pfor.digest(table(s, d, "documents"), vocabulary("byte_bpe_50k.json")),
        "op8_temperature_mix": lambda s, d: mixing.digest(table(s, d, "documents")),
        "op9_simhash": lambda s, d: simhash.digest(table(s, d, "documents")),
        "op10_pii_surrogates": lambda s, d: pii.digest(table(s, d, "documents"), PII_KEY),
        "op11_merkle_manifest": lambda s, d: merkle.manifest(table(s, d, "documents")),
        "op12_importance_resampling": lambda s, d: resample.resample(table(s, d, "documents"), table(s, d, "benchmark")),
        "op13_secret_scan": lambda s, d: secret_scan.digest(table(s, d, "documents")),
        "pipeline": _pipeline,
    }


def oracle_sql() -> dict[str, str]:
    """SQL of those that DuckDB can express; the others are tested against brute force, exact round trips or held-out accuracy."""
    return {"op6_compaction": compaction.ORACLE, "op11_merkle_manifest": merkle.ORACLE, "op12_importance_resampling": resample.ORACLE, "op3_substring_dedup": SUBSTRING, "op8_temperature_mix": MIX}


SUBSTRING = r"""
WITH split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), windows AS (
  SELECT doc_id, unnest(range(1, greatest(len(w) - 18, 1)::BIGINT)) AS i, w FROM split
), keyed AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS k FROM windows
), late AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM keyed) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM late)
), flags AS (
  SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id
)
SELECT s.doc_id, len(w)::BIGINT AS n_words, coalesce(f.n, 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN f.n IS NULL THEN w ELSE list_filter(w, lambda x, j: NOT list_contains(f.ps, j)) END, ' ')) AS kept_sha256
FROM split s LEFT JOIN flags f USING (doc_id)
"""

#: The two bisections are recursive tables; z is the sum of the raised shares.
MIX = r"""
WITH RECURSIVE counted AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM documents
), sums AS (
  SELECT source, sum(n_tokens)::BIGINT AS n, count(*) AS m FROM counted GROUP BY source
), shares AS (
  SELECT list(n::DOUBLE / total ORDER BY source) FILTER (n > 0) AS ps, max(total)::DOUBLE AS total FROM (SELECT *, sum(n) OVER () AS total FROM sums)
), cool AS (
  SELECT -1 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, 1.0::DOUBLE AS mid, ps FROM shares
  UNION ALL
  SELECT i + 1, lo, hi, (lo + hi) / 2, ps FROM (
    SELECT i, CASE WHEN good THEN mid ELSE lo END AS lo, CASE WHEN good OR i < 0 THEN hi ELSE mid END AS hi, ps FROM (
      SELECT *, ln(z) - list_sum(list_transform(up, lambda u: u * ln(u))) / z >= 0.97 * ln(len(ps)) OR len(ps) < 2 AS good FROM (
        SELECT *, list_sum(up) AS z FROM (SELECT *, list_transform(ps, lambda p: pow(p, mid)) AS up FROM cool WHERE i < 80)))
  )
), first_alpha AS (
  SELECT lo AS alpha, ps FROM cool WHERE i = 80
), warm AS (
  SELECT -1 AS i, alpha AS lo, 1.0::DOUBLE AS hi, alpha AS mid, true AS over, ps FROM first_alpha
  UNION ALL
  SELECT i + 1, lo, hi, (lo + hi) / 2, over, ps FROM (
    SELECT i, CASE WHEN beyond THEN mid ELSE lo END AS lo, CASE WHEN beyond OR i < 0 THEN hi ELSE mid END AS hi, CASE WHEN i < 0 THEN beyond ELSE over END AS over, ps FROM (
      SELECT *, list_max(list_transform(ps, lambda p: pow(p, mid) / p)) / list_sum(list_transform(ps, lambda p: pow(p, mid))) > 4.0::DOUBLE AS beyond FROM warm WHERE i < 80)
  )
), last_alpha AS (
  SELECT CASE WHEN over THEN least(1.0::DOUBLE, lo + pow(2.0::DOUBLE, -40)) ELSE (SELECT alpha FROM first_alpha) END AS alpha FROM warm WHERE i = 80
), weighed AS (
  SELECT source, n, m, CASE WHEN n > 0 THEN up / sum(up) OVER () ELSE 0.0::DOUBLE END AS weight, total FROM (
    SELECT source, n, m, total, CASE WHEN n > 0 THEN pow(n / total, alpha) END AS up FROM sums, shares, last_alpha)
), quota AS (
  SELECT source, weight, CASE WHEN n > 0 THEN weight * total / n ELSE 1.0::DOUBLE END AS passes, greatest(1, ceil((n + m) / 1048576.0::DOUBLE))::BIGINT AS n_blocks FROM weighed
), dealt AS (
  SELECT c.*, q.weight, q.passes, md5(concat_ws('|', 'mix', c.doc_id::VARCHAR)) AS key, ('0x' || substr(md5(concat_ws('|', 'mix', c.doc_id::VARCHAR)), 1, 8))::BIGINT % n_blocks AS block
  FROM counted c JOIN quota q ON c.source IS NOT DISTINCT FROM q.source
), ordered AS (
  SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY source, block ORDER BY key, doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS before,
    sum(n_tokens) OVER (PARTITION BY source, block)::DOUBLE AS in_block, row_number() OVER (PARTITION BY source, block ORDER BY key, doc_id, n_tokens) AS place
  FROM dealt
)
SELECT doc_id, source, n_tokens, (floor(passes) + (before + n_tokens / 2.0::DOUBLE < (passes - floor(passes)) * in_block)::BIGINT)::BIGINT AS copies,
  block::INTEGER AS block, place::INTEGER AS place, round(weight, 9) AS weight
FROM ordered
"""
