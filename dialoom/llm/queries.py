"""The training-data operators over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, classifier, html_text, line_dedup, lm, near_dedup, packing, quality_rules, toxicity
from .common import table

LINE_SQL = r"""
WITH base AS (SELECT doc_id AS k, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT k, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS pos FROM base),
n AS (SELECT k, pos, trim(regexp_replace(line, '^[ \t\r\x0b\x0c\x{00a0}]+|[ \t\r\x0b\x0c\x{00a0}]+$', '', 'g')) AS line FROM l),
f AS (SELECT k, pos, CASE WHEN line <> '' AND row_number() OVER (PARTITION BY line ORDER BY k, pos) > 1 THEN 1 ELSE 0 END AS gone FROM n),
g AS (SELECT k, pos, gone, pos - row_number() OVER (PARTITION BY k, gone ORDER BY pos) AS island FROM f),
r AS (SELECT k, gone, min(pos) AS start, count(*) AS len FROM g GROUP BY k, gone, island),
s AS (SELECT k, sum(len)::INT AS n_lines, sum(CASE WHEN gone = 0 THEN len ELSE 0 END)::INT AS n_kept,
  string_agg(CASE WHEN start = 0 AND gone = 1 THEN '0,' ELSE '' END || len, ',' ORDER BY start) AS keep_runs FROM r GROUP BY k)
SELECT k AS doc_id, n_lines, n_kept, keep_runs FROM s"""


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_bitmaps(table(spark, sf_dir, "documents")).drop("text_key")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.conversation_examples(table(spark, sf_dir, "conversations")))


def op4_permutation_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op7_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.corpus_perplexities(table(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importlib.import_module("corpus_pipeline").run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (op1_line_dedup, op2_quality_rules, op3_packing, op4_permutation_ann, op5_toxicity, op6_bpe, op7_kneser_ney, op8_html_extraction, op9_minhash_near_dedup, op10_quality_classifier, pipeline)
}
SQL = {"op1_line_dedup": LINE_SQL, "op2_quality_rules": quality_rules.SQL}
