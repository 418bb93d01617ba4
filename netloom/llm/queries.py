"""The registered queries of the operators, over whole tables, and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm import (
    conversations, embeddings, html, langid, line_dedup, lm, mixing, packing, pii, quality, resampling, sentencepiece, simhash,
)

#: The public model file; any other may be named in the environment.
MODEL = os.environ.get("NETLOOM_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                       F.array_join("failed_rules", ",").alias("failed_rules"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.encode_documents(table(spark, sf_dir, "documents"), MODEL)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup_counts(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_spans(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), MODEL)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_report(table(spark, sf_dir, "conversations"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resampling.scored_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


def op13_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predicted_languages(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_quality_rules, op2_sentencepiece, op3_line_dedup, op4_pii, op5_packing, op6_simhash, op7_html, op8_embeddings, op9_lm, op10_mixing,
    op11_conversations, op12_resampling, op13_langid)}

#: Resampling in SQL: the CRC-32 of each distinct feature byte by byte, with a table of 256 entries made from the polynomial.
OP12_SQL = """
WITH steps AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)),
    lambda a, i: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) AS t),
texts AS (
  SELECT 'd' AS side, row_number() OVER () AS r, doc_id, text FROM documents
  UNION ALL SELECT 't', row_number() OVER (), item_id, text FROM benchmark),
split AS (
  SELECT side, r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM texts),
features AS (
  SELECT side, r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM split),
counted AS (SELECT side, r, f, count(*) AS n FROM features GROUP BY ALL),
letters AS (SELECT f, hex(f) AS x FROM (SELECT DISTINCT f FROM counted)),
hashed AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))),
    lambda a, b: xor(a // 256, t[xor(a, b) % 256 + 1])), 4294967295) % 10000 AS bucket
  FROM letters, steps),
placed AS (SELECT side, r, bucket, sum(n) AS n FROM counted JOIN hashed USING (f) GROUP BY ALL),
sums AS (
  SELECT bucket, sum(n) FILTER (side = 'd') AS s, sum(n) FILTER (side = 't') AS t FROM placed GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0) AS s, coalesce(sum(t), 0) AS t FROM sums),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(coalesce(sums.t, 0) + 1 AS DOUBLE) * CAST(totals.s + 10000 AS DOUBLE)
    / (CAST(coalesce(sums.s, 0) + 1 AS DOUBLE) * CAST(totals.t + 10000 AS DOUBLE)))) AS BIGINT) AS gain
  FROM sums, totals),
weighed AS (
  SELECT r, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(CAST(sum(n * gain) AS DOUBLE) / CAST(sum(n) AS DOUBLE)) AS BIGINT) AS weight
  FROM placed JOIN gains USING (bucket) WHERE side = 'd' GROUP BY r),
scored AS (
  SELECT doc_id, len(w) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000.0::DOUBLE * ln(-ln(
    (CAST('0x' || substr(sha256('7:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM split LEFT JOIN weighed USING (r) WHERE side = 'd'),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (words >= 20) OVER () * 25 // 100 AS drawn
  FROM scored)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN words >= 20 AND place <= drawn THEN place END AS rank FROM ranked
"""

ORACLES: dict[str, str] = {"op12_resampling": OP12_SQL}
