"""Balanced samples, splits, exclusion and leak checks.

Sampling orders rows by a seeded sha-256 of their id: seeded, balanced and
independent of input order and partitioning.
"""

from __future__ import annotations

import hashlib
import random
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.answers import stable_key
from .checks import require, require_none


def stage_seed(seed: int, stage: str) -> int:
    """First eight bytes of a sha-256, unsigned, big end first."""
    return int.from_bytes(hashlib.sha256(f"sha256-stage-v1|{seed}|{stage}".encode()).digest()[:8], "big")


#: Up to this sample size a window ranks whole buckets; beyond, rows far from the sample are left out first.
RANKED = 1000
#: Counts of so many buckets at most come to the driver.
BUCKETS = 10_000


def quotas(sizes: dict, size: int) -> dict:
    """How many rows round robin takes from each bucket, at most: all buckets level as far as they last."""
    left, level = size, 0
    for k, n in enumerate(sorted(sizes.values())):
        take = min(n - level, left // (len(sizes) - k))
        level, left = level + take, left - take * (len(sizes) - k)
        if level < n:
            break
    return {b: min(n, level + 1) for b, n in sizes.items()}


def _near(df: DataFrame, size: int, order: Column, bucket: str) -> DataFrame:
    """Rows that may be in the sample: of each bucket those whose order key, a hash, is small enough.

    A bucket of n rows gives q; the q smallest of n uniform numbers lie below
    (q + 8 sqrt(q) + 32) / n but for one case in 10^12, and that one is noticed.
    """
    if size <= RANKED:
        return df
    counts = df.groupBy(bucket).agg(F.count("*").alias("n"))
    sizes = {r[0]: r.n for r in counts.limit(BUCKETS + 1).collect()}
    if sum(sizes.values()) < size and len(sizes) <= BUCKETS:
        raise ValueError("sample size out of range")
    if len(sizes) > BUCKETS:
        return df
    need = quotas(sizes, size)
    bound = {b: min(1.0, (q + 8 * q**0.5 + 32) / sizes[b]) for b, q in need.items()}
    cut = reduce(lambda c, b: c.when(F.col(bucket).eqNullSafe(F.lit(b)), order <= F.lit(f"{int(bound[b] * (16**12 - 1)):012x}" + "g")), bound, F.when(F.lit(False), F.lit(True)))
    few = df.where(cut)
    short = {r[0]: r.n for r in few.groupBy(bucket).agg(F.count("*").alias("n")).collect()}
    return few if all(short.get(b, 0) >= q for b, q in need.items()) else df


def balanced_sample(df: DataFrame, size: int, seed: int, key: str = "id", bucket: str = "bucket_key", compat: str = "v2") -> DataFrame:
    """``size`` rows, spread over the buckets as evenly as their sizes allow; fails if there are not as many.

    Round robin is an order: by rank within the bucket, then by bucket.  A
    window partitioned by bucket ranks, and a top-k keeps ``size`` rows, so no
    global sort is needed.  Of large samples only rows near the sample are
    ranked.  Buckets go in seeded order (v2) or by name (v1).
    """
    order = stable_key(seed, F.col(key))
    rank = F.row_number().over(W.partitionBy(bucket).orderBy(order, F.col(key)))
    turn = stable_key(seed, F.col(bucket)) if compat == "v2" else F.col(bucket)
    ranked = _near(df, size, order, bucket).withColumn("_rank", rank).withColumn("_turn", turn)
    # rows beyond ``size`` of one bucket cannot be reached
    out = ranked.where(F.col("_rank") <= size).orderBy("_rank", "_turn").limit(size).drop("_rank", "_turn")
    if size > RANKED:
        return out
    have = F.count("*").over(W.partitionBy())  # of a thousand rows at most
    return require(out.withColumn("_have", have), F.col("_have") >= size, "sample size out of range").drop("_have")


def exact_ids(pools: dict[str, list], size: int, seed: int) -> list:
    """Ids of a balanced sample by Python's own seeded shuffles, in the order that they give.

    The order in which buckets take turns is shuffled first, then each bucket's
    rows, bucket by bucket in order of name, and last the whole sample.
    """
    if not 0 <= size <= sum(map(len, pools.values())):
        raise ValueError("sample size out of range")
    rng = random.Random(seed)
    names = sorted(pools)
    turns = list(names)
    rng.shuffle(turns)
    mixed = {}
    for n in names:
        mixed[n] = list(pools[n])
        rng.shuffle(mixed[n])
    share = dict.fromkeys(names, 0)
    while sum(share.values()) < size:
        for n in turns:
            if share[n] < len(mixed[n]) and sum(share.values()) < size:
                share[n] += 1
    picked = [x for n in names for x in mixed[n][: share[n]]]
    rng.shuffle(picked)
    return picked


def exact_sample(df: DataFrame, size: int, seed: int, key: str = "id", bucket: str = "bucket_key", position: str | None = None) -> DataFrame:
    """The sample that Python's own seeded shuffles give, with its order as ``_place``.

    For small pools only, since (id, bucket) pairs come to the driver in the
    order of ``position`` (of ids without it): more than a million are refused.
    """
    rows = df.orderBy(position or key).select(key, bucket).limit(1_000_001).collect()
    if len(rows) > 1_000_000:
        raise ValueError("an exact sample needs a pool of a million rows at most; use balanced_sample")
    pools: dict[str, list] = {}
    for r in rows:
        pools.setdefault(r[1], []).append(r[0])
    chosen = [(x, k) for k, x in enumerate(exact_ids(pools, size, seed))]
    schema = T.StructType([df.schema[key], T.StructField("_place", T.IntegerType())])
    return df.join(df.sparkSession.createDataFrame(chosen, schema), key)


def exclude(df: DataFrame, gone: DataFrame, key: str = "id", strict: bool = True) -> DataFrame:
    """Rows whose id is not excluded; in strict mode every excluded id must exist, once."""
    if strict:
        require_none(gone.join(df, key, "left_anti"), "an excluded id is unknown")
        require_none(gone.groupBy(key).count().where("count > 1"), "an id is excluded twice")
    return df.join(gone.select(key), key, "left_anti")


def leaked(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """Ids that both sides have."""
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_semi")


def same_ids(a: DataFrame, b: DataFrame, key: str = "id") -> bool:
    """Do both sides hold the same multiset of ids?"""
    x, y = a.select(key), b.select(key)
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()


def three_way_split(df: DataFrame, val_size: int, eval_size: int, seed: int, key: str = "id", bucket: str = "bucket_key") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(train, validation, evaluation): evaluation is a part of validation, train is the rest."""
    val = balanced_sample(df, val_size, stage_seed(seed, "validation"), key, bucket)
    return exclude(df, val, key, strict=False), val, balanced_sample(val, eval_size, stage_seed(seed, "evaluation"), key, bucket)


def in_source_order(sample: DataFrame, source: DataFrame, key: str = "id", position: str = "source_index") -> DataFrame:
    """A sample in the order of its source."""
    return sample.drop(position).join(source.select(key, position), key).orderBy(position)
