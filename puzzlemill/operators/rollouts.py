"""Rollout expansion, response merging, acceptance and prefixes."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.answers import plain_response
from .checks import require


def expand(df: DataFrame, k: int, position: str = "source_index", first: int = 0) -> DataFrame:
    """Every row k times, with rollout_index and a running position."""
    out = df.withColumn("rollout_index", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(k - 1).cast("bigint"))))
    return out.withColumn("position", (F.col(position) - first) * k + F.col("rollout_index"))


def expand_routes(df: DataFrame, routes: list[str], k: int, position: str = "source_index", first: int = 0) -> DataFrame:
    """Every row for every route k times; positions run by row, route, rollout."""
    out = df.withColumn("_route", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(r).alias("r")) for i, r in enumerate(routes)])))
    out = out.withColumn("rollout_index", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(k - 1).cast("bigint")))).withColumn("generation_route", F.col("_route.r"))
    return out.withColumn("position", ((F.col(position) - first) * len(routes) + F.col("_route.i")) * k + F.col("rollout_index")).drop("_route")


def source_position(position: Column, k: int) -> Column:
    return F.floor(position / k)


def shard(position: Column, total: Column | int) -> Column:
    """Two contiguous shards; an odd row goes to shard 0."""
    return F.when(position < F.ceil(F.lit(total) / 2 if isinstance(total, int) else total / 2), 0).otherwise(1)


def merge_responses(requests: DataFrame, responses: DataFrame, position: str = "position") -> DataFrame:
    """Requests with their responses: each request has one, each response belongs to one."""
    counted = responses.withColumn("_n", F.count("*").over(W.partitionBy(position)))
    r = counted.withColumnRenamed(position, "_p")
    both = requests.withColumn("_asked", F.lit(True)).join(r, F.col(position) == F.col("_p"), "full_outer")
    both = require(both, F.col("_asked").isNotNull(), "a response without request")
    both = require(both, F.col("_p").isNotNull(), "a request without response")
    return require(both, F.col("_n") == 1, "two responses to one request").drop("_asked", "_p", "_n")


def first_texts(df: DataFrame, source: str = "id", response: str = "response", position: str = "position") -> DataFrame:
    """The earliest of equal responses to one source."""
    w = W.partitionBy(source, response).orderBy(position)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def accept_rollouts(df: DataFrame, most: int = 2, source: str = "id", response: str = "response", position: str = "position") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of rows with a boolean ``ok``.

    Texts are normalised and taken once for each source; the first ``most``
    correct ones are accepted, further correct ones belong to neither side.
    """
    rows = first_texts(df.withColumn(response, plain_response(F.col(response))), source, response, position)
    rank = F.row_number().over(W.partitionBy(source, "ok").orderBy(position))
    ranked = rows.withColumn("_rank", rank)
    return ranked.where(F.col("ok") & (F.col("_rank") <= most)).drop("_rank"), rows.where("not ok")


def every_record(accepted: DataFrame, rejected: DataFrame) -> DataFrame:
    """All records of a collection, for uniqueness and prefix checks; a column that one side lacks is null."""
    return accepted.unionByName(rejected, allowMissingColumns=True)


def accept_all(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """v1: every correct rollout is accepted."""
    return df.where("ok"), df.where("not ok")


def cut_at_target(df: DataFrame, target: int, position: str = "position") -> DataFrame:
    """Rows up to the one that completes ``target`` correct rows; all rows if none does.

    The cutoff is a top-k and a maximum, one row to join; nothing is sorted
    globally, and the rows, which both read, are kept.
    """
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    reached = df.where("ok").orderBy(position).limit(target).agg(F.count("*").alias("_n"), F.max(position).alias("_last"))
    reached = reached.select(F.when(F.col("_n") == target, F.col("_last")).alias("_last"))
    last = reached.select("_last").scalar()
    return df.where(F.coalesce(F.col(position) <= last, F.lit(True)))


def prefix_report(done: DataFrame, source: DataFrame, position: str = "source_index", key: str = "id", first: int = 0) -> DataFrame:
    """One row: is what is done an exact, unique and known prefix of the source?"""
    known = done.join(source.select(key, F.col(position).alias("_at")), key, "left")
    one = known.agg(F.count("*").alias("n"), F.countDistinct(key).alias("distinct_ids"), F.count("_at").alias("known"), (F.max("_at") - first + 1).alias("span"))
    return one.select("n", "distinct_ids", "known", (F.col("n") == 0).__or__((F.col("n") == F.col("distinct_ids")) & (F.col("n") == F.col("known")) & (F.col("n") == F.col("span"))).alias("is_prefix"))


def unprocessed(source: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    return source.join(done.select(key).distinct(), key, "left_anti")
