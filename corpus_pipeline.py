"""Corpus cleaning in five stages, from raw documents to a mix of sources.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps,
with the columns of ``documents``; the last returns the mix: which document is
taken how often.  Stages may be run one by one, each over what the one before
has written, or all by ``run``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from puzzlemill.llm import decontam, linededup, mixing, neardup, toxicity
from puzzlemill.llm.common import checkpoint, read


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression-distance classifier calls toxic go."""
    return toxicity.drop_toxic(docs, read(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines like an earlier line go, and documents of which nothing remains."""
    out = linededup.drop_repeated_lines(docs)
    out = out.where((F.col("n_removed") == 0) | (F.length(F.btrim("text", F.lit(" \t\n\x0b\x0c\r"))) > 0))
    n_chars = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.withColumn("n_chars", n_chars).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 80 % of its five-word shingles stays."""
    return neardup.drop_near_duplicates(docs, width=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each document that is left is taken, so that sources meet their targets."""
    out = mixing.mix_sources(docs)
    taken = F.col("copies") * F.col("size")
    return out.select("doc_id", "source", "size", "source_size", "target", F.when(F.col("size") > 0, F.col("copies")).otherwise(0).alias("copies"), taken.alias("taken"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix),
]
#: Learned scores and hashed draws are not expressible in SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
