"""Registered queries of the corpus operators: digests of whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, licenses, linededup, logbilinear, mixing, neardup, spotsigs, substrings, toxicity
from .common import read


def op1_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edited_likeness(read(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", F.when(F.col("size") > 0, F.col("copies")).alias("copies"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.drop_repeated_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "contaminated", "items", "n_spans", F.array_min("spans.edits").alias("least_edits"))


def op7_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.neighbour_preferences(read(spark, sf_dir, "conversations"))
    spans = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("-", x["from"].cast("string"), x["to"].cast("string"))), ",")
    return out.select("conv_id", "prompt_turns", "prompt", "chosen", "rejected", spans("chosen_spans").alias("chosen_spans"), spans("rejected_spans").alias("rejected_spans"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"), width=2, percent=80)


def op9_drop_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.drop_repeats(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("bigint").alias("n_spans"), "kept_sha256")


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logbilinear.score_documents(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_spotsigs": op1_spotsigs,
    "op2_toxicity": op2_toxicity,
    "op3_mix_sources": op3_mix_sources,
    "op4_licenses": op4_licenses,
    "op5_line_dedup": op5_line_dedup,
    "op6_decontaminate": op6_decontaminate,
    "op7_preferences": op7_preferences,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_drop_repeats": op9_drop_repeats,
    "op10_lm_scores": op10_lm_scores,
}
#: Preference pairs in SQL.  The other operators learn, draw by hashes that SQL
#: engines do not share, or search beyond SQL; tests hold them against plain Python.
ORACLE_SQL: dict[str, str] = {
    "op7_preferences": """
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS txt, row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, max(i) AS n, max(CASE WHEN role = 'assistant' THEN i END) AS last FROM t GROUP BY conv_id),
r AS (SELECT t.conv_id, t.txt FROM t JOIN l ON t.conv_id = l.conv_id AND t.i = l.last),
p AS (SELECT l.conv_id, l.n, l.last, other.txt AS reply, CASE WHEN l.last IS NULL THEN l.n WHEN other.txt = own.txt THEN l.last ELSE l.last - 1 END AS prompt_turns
  FROM l LEFT JOIN r own ON own.conv_id = l.conv_id LEFT JOIN r other ON other.conv_id = xor(l.conv_id, 1)),
s AS (SELECT t.conv_id, t.i, t.role, p.prompt_turns, '<|im_start|>' || replace(replace(t.role, '<|im_', '<| im_'), chr(13), '') || chr(10) || replace(replace(t.txt, '<|im_', '<| im_'), chr(13), '') || '<|im_end|>' || chr(10) AS shown FROM t JOIN p ON t.conv_id = p.conv_id),
o AS (SELECT *, coalesce(sum(length(shown)) OVER (PARTITION BY conv_id, i > prompt_turns ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM s),
a AS (SELECT conv_id, coalesce(string_agg(CASE WHEN i <= prompt_turns THEN shown END, '' ORDER BY i), '') AS prompt, coalesce(string_agg(CASE WHEN i > prompt_turns THEN shown END, '' ORDER BY i), '') AS chosen,
  coalesce(string_agg(CASE WHEN i > prompt_turns AND role = 'assistant' THEN CAST(CAST(start + 22 AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(start + length(shown) - 1 AS BIGINT) AS VARCHAR) END, ',' ORDER BY i), '') AS chosen_spans FROM o GROUP BY conv_id),
j AS (SELECT conv_id, prompt_turns, CASE WHEN last IS NULL OR reply IS NULL OR prompt_turns = last THEN '' ELSE '<|im_start|>assistant' || chr(10) || replace(replace(reply, '<|im_', '<| im_'), chr(13), '') || '<|im_end|>' || chr(10) END AS rejected FROM p)
SELECT a.conv_id, j.prompt_turns, a.prompt, a.chosen, j.rejected, a.chosen_spans, CASE WHEN j.rejected = '' THEN '' ELSE '22-' || CAST(length(j.rejected) - 1 AS VARCHAR) END AS rejected_spans FROM a JOIN j ON a.conv_id = j.conv_id
""",
}
