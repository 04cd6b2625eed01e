"""Scans: Parquet, JSON documents and lines, logs, directory discovery."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schemas


def parquet_rows(spark: SparkSession, path: str, limit: int | None = None, position: str = "source_index") -> DataFrame:
    """A Parquet scan; ``limit`` keeps the first positions, pushed down to the files."""
    df = spark.read.parquet(path)
    return df if limit is None else df.where(F.col(position) <= limit)


def numbered(df: DataFrame, position: str = "source_index", first: int = 1) -> DataFrame:
    """Positions in the order of partitions, consecutive and from ``first``.

    Row numbers within partitions are native ids; one pass counts the
    partitions, whose small table is joined.  The plan must give the same
    partitions twice, as scans do; use a stored column where there is one.
    """
    rows = df.withColumn("_id", F.monotonically_increasing_id())
    part = F.shiftright("_id", 33)
    counts = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))
    before = counts.select("_part", (F.sum("n").over(W.orderBy("_part")) - F.col("n")).alias("_before"))  # one row for each partition
    rows = rows.withColumn("_part", part).join(F.broadcast(before), "_part")
    return rows.withColumn(position, F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before") + first).drop("_id", "_part", "_before")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) with 1-based line numbers, however files are split."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"))
    splits = rows.groupBy("file", "_start").agg(F.count("*").alias("n"), F.min("_id").alias("_least"))
    # one row for each split of a file
    before = splits.withColumn("_before", F.sum("n").over(W.partitionBy("file").orderBy("_start")) - F.col("n")).drop("n")
    return rows.join(F.broadcast(before), ["file", "_start"]).select("file", (F.col("_id") - F.col("_least") + F.col("_before") + 1).alias("line"), "value")


def bad_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(file, line, value) of lines that are no object of the schema; blank lines are none."""
    parsed = F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    rows = text_lines(spark, path).where(F.length(F.btrim("value")) > 0).withColumn("_row", parsed)
    return rows.where(F.col("_row").isNull() | F.col("_row._bad").isNotNull() | ~F.startswith(F.ltrim("value"), F.lit("{"))).drop("_row")


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that holds one JSON array."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON lines; strict reading fails on a bad line, else bad lines stand in _corrupt_record."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return spark.read.schema(f"{schema}, _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def json_lines_checked(spark: SparkSession, path: str, schema: str, validate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """JSON lines that are objects of the schema and pass a validator that adds ``violations``; errors name the line."""
    if wrong := bad_lines(spark, path, schema).orderBy("file", "line").first():
        raise ValueError(f"{wrong.file}:{wrong.line}: not an object of the schema")
    numbered_ = text_lines(spark, path).where(F.length(F.btrim("value")) > 0).select("file", "line", F.from_json("value", schema).alias("_row"))
    rows = numbered_.select(F.col("file").alias("_file"), F.col("line").alias("_line"), "_row.*")
    if wrong := validate(rows).where(F.size("violations") > 0).orderBy("_file", "_line").first():
        raise ValueError(f"{wrong._file}:{wrong._line}: {', '.join(wrong.violations)}")
    return json_lines(spark, path, schema)


def records(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """JSON lines of a declared record type, by its name in ``schemas``."""
    return json_lines(spark, path, getattr(schemas, kind.upper()))


def step_files(spark: SparkSession, path: str, schema: str, pattern: str = r"step_(\d+)\.jsonl$") -> DataFrame:
    """Rows of all files whose name matches, with the step from the name."""
    rows = spark.read.schema(schema).json(path)
    step = F.regexp_extract(F.col("_metadata.file_path"), pattern, 1).try_cast("bigint")
    return rows.withColumn("step", step).where("step is not null")


def step_directories(path: str | Path, prefix: str = "global_step_") -> list[tuple[int, str]]:
    """(step, path) of checkpoint directories, by step."""
    found = [(int(p.name.removeprefix(prefix)), str(p)) for p in Path(path).iterdir() if p.is_dir() and p.name.startswith(prefix) and p.name.removeprefix(prefix).isdigit()]
    return sorted(found)


def eval_ledger(spark: SparkSession, path: str) -> DataFrame:
    """(step, accuracy, format_rate) from a ledger of evaluations."""
    rows = records(spark, path, "ledger")
    return rows.select("step", "metrics.accuracy", "metrics.format_rate")


def adapter_bases(spark: SparkSession, path: str) -> DataFrame:
    """(file, base) of adapter configurations."""
    raw = spark.read.option("wholetext", True).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.get_json_object("value", "$.base_model_name_or_path").alias("base"))
