"""Evaluation and rollout metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _share(flag: Column) -> Column:
    return F.coalesce(F.avg(F.coalesce(flag, F.lit(False)).cast("double")), F.lit(0.0))


def _total(flag: Column) -> Column:
    return F.coalesce(F.sum(F.coalesce(flag, F.lit(False)).cast("bigint")), F.lit(0))


def eval_summary(samples: DataFrame, *by: str, compat: str = "v2") -> DataFrame:
    """Rates and lengths; without ``by`` an empty input gives one row of zeros."""
    valid = F.col("correct") if compat == "v1" else F.col("valid_expression")
    cells = [
        F.count("*").alias("count"),
        _share(F.col("correct")).alias("accuracy"),
        _share(F.col("format_ok")).alias("format_rate"),
        _share(valid).alias("valid_expression_rate"),
        F.coalesce(F.avg("generated_tokens"), F.lit(0.0)).alias("avg_generated_tokens"),
    ]
    if compat == "v2":
        cells.append(F.coalesce(F.max("generated_tokens"), F.lit(0)).cast("bigint").alias("max_generated_tokens"))
    cells.append(_total(F.col("truncated")).alias("truncated_count"))
    if compat == "v2":
        cells.append(_share(F.col("truncated")).alias("truncated_rate"))
    return samples.groupBy(*by).agg(*cells) if by else samples.agg(*cells)


def _groups(rows: DataFrame, size: int, position: str) -> DataFrame:
    """Statistics of each contiguous group; equal rewards have no spread, whatever the rounding."""
    g = rows.groupBy(F.floor(F.col(position) / size).alias("group"))
    g = g.agg(F.count("*").alias("n"), F.min("reward").alias("low"), F.max("reward").alias("high"), F.stddev_pop("reward").alias("std"))
    return g.withColumn("std", F.when(F.col("low") == F.col("high"), 0.0).otherwise(F.col("std")))


def rollout_metrics(rows: DataFrame, size: int, position: str = "position", correct: float = 1.2, formed: float = 0.2, diagnosed: bool = True, entropy: float | None = None) -> DataFrame:
    """One row of metrics over rollouts in contiguous groups of ``size``.

    Accuracy and format rate come from answer_correct and format_ok if the rows
    are ``diagnosed``, else from the rewards.  ``kl`` is 0, since no reference
    model takes part; ``entropy`` is passed on if it is known.  One pass makes
    the groups, another one sums them up, so rows are read once.
    """
    right, shaped = (F.col("answer_correct"), F.col("format_ok")) if diagnosed else (F.col("reward") >= correct, F.col("reward") >= formed)
    groups = rows.groupBy(F.floor(F.col(position) / size).alias("group")).agg(
        F.count("*").alias("n"),
        F.count("reward").alias("rewarded"),
        F.min("reward").alias("low"),
        F.max("reward").alias("high"),
        F.sum("reward").alias("sum"),
        F.avg("reward").alias("mean"),
        F.var_pop("reward").alias("var"),
        _total(right).alias("right"),
        _total(shaped).alias("shaped"),
        F.sum("response_length").alias("length"),
        F.count("response_length").alias("lengths"),
        F.max("response_length").alias("longest"),
        _total(F.col("truncated")).alias("cut"),
    )
    std = F.when(F.col("low") == F.col("high"), 0.0).otherwise(F.sqrt("var"))
    over = lambda a, b: F.coalesce(F.try_divide(F.sum(a).cast("double"), F.sum(b)), F.lit(0.0))
    # the spread of all: mean of the squares, which groups give, less the square of the mean
    total = F.sum("rewarded")
    square = F.sum(F.col("var") * F.col("rewarded") + F.col("mean") * F.col("mean") * F.col("rewarded"))
    mean = F.try_divide(F.sum("sum"), total)
    spread = F.when(F.min("low") == F.max("high"), 0.0).otherwise(F.coalesce(F.sqrt(F.greatest(F.lit(0.0), F.try_divide(square, total) - mean * mean)), F.lit(0.0)))
    cells = [
        F.coalesce(F.sum("n"), F.lit(0)).alias("count"),
        F.coalesce(mean, F.lit(0.0)).alias("reward"),
        spread.alias("reward_std"),
        over("right", "n").alias("accuracy"),
        over("shaped", "n").alias("format_rate"),
        over("length", "lengths").alias("avg_response_length"),
        F.coalesce(F.max("longest"), F.lit(0)).cast("bigint").alias("max_response_length"),
        F.coalesce(F.sum("cut"), F.lit(0)).alias("truncated_count"),
        over("cut", "n").alias("truncated_rate"),
        F.coalesce(F.avg(std), F.lit(0.0)).alias("group_reward_std"),
        _share(std == 0).alias("frac_reward_zero_std"),
        _share(F.col("low") >= correct).alias("all_correct_group_fraction"),
        _share(F.col("high") <= 0).alias("all_wrong_group_fraction"),
        F.lit(0.0).alias("kl"),
    ]
    if entropy is not None:
        cells.append(F.lit(float(entropy)).alias("entropy"))
    return groups.agg(*cells)


def group_summary(rows: DataFrame, size: int, position: str = "position") -> DataFrame:
    """v1: spread overall and by group; an incomplete last group is left out."""
    groups = _groups(rows, size, position).where(F.col("n") == size)
    by_group = groups.agg(F.coalesce(F.avg("std"), F.lit(0.0)).alias("group_reward_std"), _share(F.col("std") == 0).alias("frac_reward_zero_std"))
    spread = F.when(F.min("reward") == F.max("reward"), 0.0).otherwise(F.coalesce(F.stddev_pop("reward"), F.lit(0.0)))
    return rows.agg(spread.alias("reward_std")).withColumn("_k", F.lit(1)).join(by_group.withColumn("_k", F.lit(1)), "_k").drop("_k")


def step_metrics(rows: DataFrame, by: str, null_is_zero: bool = True) -> DataFrame:
    """A metric row for each step: rates and lengths of its rollouts, rounded where lengths may be missing."""
    tokens = F.coalesce(F.col("token_count"), F.lit(0)) if null_is_zero else F.col("token_count")
    mean = F.coalesce(F.avg(tokens), F.lit(0.0))
    return rows.groupBy(by).agg(
        F.count("*").alias("rollout_count"),
        F.avg("reward").alias("mean_reward"),
        _share(F.col("answer_correct")).alias("accuracy"),
        _share(F.col("format_ok")).alias("format_rate"),
        (mean if null_is_zero else F.round(mean, 12)).alias("avg_gen_tokens"),
        F.coalesce(F.max(tokens), F.lit(0)).cast("bigint").alias("max_gen_tokens"),
        _total(F.col("truncated")).alias("truncated_count"),
    )


def bucket_metrics(rows: DataFrame) -> DataFrame:
    """Rates by bucket; rows without one are left out."""
    known = rows.where("bucket is not null and bucket <> ''")
    return known.groupBy("bucket").agg(_share(F.col("answer_correct")).alias("accuracy"), _share(F.col("format_ok")).alias("format_rate"), F.avg("reward").alias("reward"))


def wide_bucket_metrics(rows: DataFrame, buckets: list[str]) -> DataFrame:
    """The same as one row with columns bucket/<name>/<metric>."""
    cells = []
    for b in buckets:
        mine = F.col("bucket") == b
        for name, value in (("accuracy", F.col("answer_correct").cast("double")), ("format_rate", F.col("format_ok").cast("double")), ("reward", F.col("reward"))):
            cells.append(F.avg(F.when(mine, value)).alias(f"bucket/{b}/{name}"))
    return rows.agg(*cells)


def group_advantages(rows: DataFrame, size: int, clip: float, position: str = "position") -> DataFrame:
    """(reward - mean) / deviation within each group, clipped; 0 where rewards are equal.

    An incomplete last group counts as a group.
    """
    w = W.partitionBy(F.floor(F.col(position) / size))
    equal = F.min("reward").over(w) == F.max("reward").over(w)
    z = (F.col("reward") - F.avg("reward").over(w)) / F.stddev_pop("reward").over(w)
    return rows.withColumn("advantage", F.when(equal, 0.0).otherwise(F.greatest(F.lit(-clip), F.least(F.lit(clip), z))))


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    """Numeric columns under prefixed names; booleans and text are dropped."""
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double")
    return df.select(*[F.col(f"`{c}`").alias(f"{prefix}/{c}") for c, t in df.dtypes if t in numeric])
