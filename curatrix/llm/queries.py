"""The queries of the training-data operators over the input tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.llm import alignment, blob_ledger, bpe_words, brown_lm, covering_simhash, knn_quality, norm_topk, pii_surrogates, png_media, slack_packing, speculative_bpe, toxicity, whitening
from curatrix.llm.common import table


def op1_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.scored(table(spark, sf_dir, "documents"))


def op2_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blob_ledger.digest(blob_ledger.findings(table(spark, sf_dir, "documents")))


def op3_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slack_packing.pack(table(spark, sf_dir, "documents"))


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_surrogates.replaced(table(spark, sf_dir, "documents"))


def op5_norm_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return norm_topk.top_products(table(spark, sf_dir, "embeddings"))


def op6_png_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return png_media.media_features(png_media.media_table(table(spark, sf_dir, "documents")))


def op7_boosted_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = covering_simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", covering_simhash.hex_print("fp").alias("fingerprint"), "component_id")


def op9_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn_quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_bpe_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_words.digests(table(spark, sf_dir, "documents"))


def op11_speculative_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speculative_bpe.digests(table(spark, sf_dir, "documents"))


def op12_exact_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS long)"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_brown_lm, op2_blob_ledger, op3_slack_packing, op4_pii_surrogates, op5_norm_topk, op6_png_media, op7_boosted_toxicity, op8_covering_simhash, op9_knn_quality, op10_bpe_words, op11_speculative_bpe, op12_exact_whitening, op13_token_alignment)}

ORACLE_SQL = {
    # a match begins behind all gaps and matches before it; without a kept ledger every blob is scanned with all six rules
    "op2_blob_ledger": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
k(kind, place, pattern, part, least) AS (VALUES
  ('assign', 0, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 6),
  ('access', 1, 'AKIA[A-Z0-9]+', 0, 20),
  ('hex', 2, '[0-9a-f]+', 0, 24),
  ('pem', 3, '-----BEGIN [A-Z ]*PRIVATE KEY-----', 0, 1),
  ('jwt', 4, 'eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}', 0, 1),
  ('hosting', 5, 'gh[pousr]_[A-Za-z0-9]{36,}', 0, 1)),
f AS (SELECT rid, kind, place, least, regexp_extract_all(t, pattern) AS m, CASE WHEN part = 2 THEN regexp_extract_all(t, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) ELSE regexp_extract_all(t, pattern) END AS g, string_split_regex(t, pattern) AS gaps FROM d, k WHERE regexp_matches(t, pattern)),
p AS (SELECT rid, kind, place, least, unnest(range(1, len(m) + 1)) AS i, m, g, gaps FROM f),
s AS (SELECT rid, kind, place, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a, length(m[i]) AS n FROM p WHERE length(g[i]) >= least),
o AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
        string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, place) FILTER (place < 3) AS base, string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, place) AS spans FROM s GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, sha256(t) AS blob, CAST(6 AS BIGINT) AS scanned, CAST(0 AS BIGINT) AS reused
FROM d LEFT JOIN o USING (rid)
""",
    "op5_norm_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM (SELECT DISTINCT vec_id, v FROM v WHERE vec_id % 100 = 0) q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
""",
}
