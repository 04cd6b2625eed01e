"""Assertions as plans: a violated rule fails the job that reads the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require(df: DataFrame, rule: Column, message: str) -> DataFrame:
    """``df``, failing with ``message`` on a row that breaks the rule."""
    return df.where(F.when(rule, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def duplicate_ids(df: DataFrame, key: str) -> DataFrame:
    """(key, n) of ids that occur more than once; null counts as an id."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def require_none(df: DataFrame, message: str) -> None:
    """Fail if the DataFrame has a row; at most one is fetched."""
    if not df.isEmpty():
        raise ValueError(message)
