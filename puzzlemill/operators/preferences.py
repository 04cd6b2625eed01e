"""Preference pairs: candidate classes, quotas, route balance, backfill."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.answers import stable_key
from .checks import require
from .steps import cut

# Categories by priority, their shares, and the two routes.
QUOTAS = {"wrong_value": 0.70, "number_mismatch": 0.15, "invalid_expression": 0.10, "missing_answer_tag": 0.03, "truncated": 0.02}
CATEGORIES = list(QUOTAS)
ROUTES = ["forced_wrong", "high_temp"]
MALFORMED = ["invalid_expression", "missing_answer_tag", "truncated"]


def category(truncated: Column, error: Column) -> Column:
    """Truncation outweighs what the text says; a correct rollout is unexpected."""
    return F.when(truncated, "truncated").when(error.isNull(), "unexpected_correct").otherwise(error)


def category_rank(column: Column) -> Column:
    return F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), column)


def category_quotas(target: int) -> dict[str, int]:
    """Whole shares of the target; what is left goes one by one down the priority."""
    if target <= 0:
        raise ValueError("the target must be positive")
    out = {c: int(target * share) for c, share in QUOTAS.items()}
    for c in CATEGORIES[: max(0, target - sum(out.values()))]:
        out[c] += 1
    return out


def route_order(df: DataFrame, need: int) -> DataFrame:
    """The first ``need`` candidates when routes take turns, in stable order (``_key``) within a route.

    Of each route a top-k is enough, so no route's rows meet in one task.
    """
    order = ["_key", "source_id", "candidate_id"]
    heads = [df.where(F.col("generation_route") == r).orderBy(*order).limit(need) for r in ROUTES]
    other = df.where(~F.coalesce(F.col("generation_route").isin(ROUTES), F.lit(False))).orderBy("generation_route", *order).limit(need)
    few = reduce(DataFrame.unionByName, [*heads, other])
    turn = F.row_number().over(W.partitionBy("generation_route").orderBy(*order))
    return few.withColumn("_turn", turn).orderBy("_turn", "generation_route").limit(need).drop("_turn")


def select_pairs(candidates: DataFrame, chosen: DataFrame, target: int, seed: int, unique_source: bool = False) -> DataFrame:
    """``target`` candidates, by category quota and route balance, then backfill by priority.

    A source that a category has used is not used by a later one.  As in the
    plan this follows, one category (and the backfill) may still take two
    candidates of one source; ``unique_source`` forbids that.  ``chosen`` has the
    column id.  Five quotas are five bounded top-k steps over a pool that is
    written, so candidates are made once.
    """
    known = chosen.select(F.col("id").alias("source_id")).distinct()
    pool = candidates.where(F.col("rejected_category").isin(CATEGORIES)).join(known, "source_id", "left_semi")
    pool = pool.withColumn("_key", stable_key(seed, F.col("source_id"), F.col("candidate_id")))
    pool = cut(pool)
    if unique_source:
        best = W.partitionBy("source_id").orderBy(category_rank(F.col("rejected_category")), "_key")
        pool = pool.withColumn("_best", F.row_number().over(best)).where("_best = 1").drop("_best")
    picked: DataFrame | None = None
    for name, need in category_quotas(target).items():
        free = pool.where(F.col("rejected_category") == name)
        if picked is not None:
            free = free.join(picked.select("source_id").distinct(), "source_id", "left_anti")
        taken = cut(route_order(free, need))
        picked = taken if picked is None else picked.unionByName(taken)
    rest = pool.join(picked.select("source_id").distinct(), "source_id", "left_anti")
    order = [F.col("_late"), category_rank(F.col("rejected_category")), F.col("_key")]
    both = picked.withColumn("_late", F.lit(0)).unionByName(rest.withColumn("_late", F.lit(1)))
    return both.orderBy(*order).limit(target).drop("_late", "_key")


def select_pairs_v1(candidates: DataFrame, target: int, malformed_share: float) -> DataFrame:
    """v1: by priority, source, route and arrival; malformed ones only up to a share of the target.

    Takes source_id, source_index, generation_route, rejected_category, arrival.
    """
    rank = F.when(F.col("rejected_category") == "wrong_value", 0).when(F.col("rejected_category") == "number_mismatch", 1).otherwise(category_rank(F.col("rejected_category")) - 1)
    order = ["_rank", "source_index", "generation_route", "arrival"]
    pool = candidates.where("rejected_category <> 'unexpected_correct'").withColumn("_rank", rank)
    bad = pool.where(F.col("rejected_category").isin(MALFORMED)).orderBy(*order).limit(math.floor(target * malformed_share))
    good = pool.where(~F.col("rejected_category").isin(MALFORMED)).orderBy(*order).limit(target)
    few = good.unionByName(bad).orderBy(*order).limit(target)  # target rows at most meet in one task
    out = few.withColumn("_n", F.row_number().over(W.orderBy(*order)) - 1)
    return out.withColumn("id", F.concat_ws("-dpo-", "source_id", F.col("_n").cast("string"))).drop("_rank", "_n")


def route_budgets(shares: dict[str, float], budget: int, most: int) -> dict[str, int]:
    """Requests for each route: proportional, largest remainders first, then round robin, each capped."""
    on = {r: s for r, s in shares.items() if s > 0}
    if not on or budget <= 0:
        return {}
    raw = {r: budget * s / sum(on.values()) for r, s in on.items()}
    out = {r: min(most, math.floor(x)) for r, x in raw.items()}
    queue = sorted(on, key=lambda r: (raw[r] - math.floor(raw[r]), r), reverse=True)
    while sum(out.values()) < budget and any(out[r] < most for r in on):
        for r in queue:
            if out[r] < most and sum(out.values()) < budget:
                out[r] += 1
        queue = list(on)
    return out


def route_requests(rows: DataFrame, shares: dict[str, float], target: int, oversample: float, n_rows: int, position: str = "source_index") -> DataFrame:
    """v1 requests: rows in order, each with the routes whose budget still lasts.

    A route asks each row once, so rows beyond the largest budget cannot be
    reached: a top-k of the whole table, and only its rows are numbered.
    """
    on = [r for r, s in shares.items() if s > 0]
    budget = min(n_rows * len(on), math.ceil(target * oversample))
    limits = route_budgets(shares, budget, n_rows)
    first = rows.orderBy(position).limit(max(limits.values(), default=0))
    first = first.withColumn("_at", F.row_number().over(W.orderBy(position)) - 1)
    routes = F.filter(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(r).alias("r"), F.lit(limits.get(r, 0)).alias("n")) for i, r in enumerate(on)]), lambda x: F.col("_at") < x["n"])
    out = first.withColumn("_r", F.explode(routes)).withColumn("generation_route", F.col("_r.r"))
    return out.orderBy("_at", "_r.i").limit(budget).drop("_r", "_at")


def pair_records(pairs: DataFrame, chosen: DataFrame, candidates: DataFrame) -> DataFrame:
    """Whole preference records of selected pairs (source_id, candidate_id).

    ``chosen`` gives prompt and response by id, ``candidates`` the rejected text;
    a pair whose source is no chosen row, or whose texts are empty or equal, fails.
    """
    good = chosen.select(F.col("id").alias("source_id"), "prompt", F.col("response").alias("chosen"))
    bad = candidates.select("source_id", "candidate_id", "rejected")
    rows = pairs.drop("prompt", "chosen", "rejected").join(good, "source_id", "left").join(bad, ["source_id", "candidate_id"], "left")
    filled = [F.coalesce(F.length(F.btrim(c)) > 0, F.lit(False)) for c in ("prompt", "chosen", "rejected")]
    rows = require(rows, filled[0] & filled[1] & filled[2], "a pair has an empty prompt, chosen or rejected text")
    rows = require(rows, F.col("chosen") != F.col("rejected"), "a pair's chosen and rejected texts are equal")
    provenance = F.struct("source_id", "candidate_id", F.lit("preference").alias("stage"))
    return rows.select("prompt", "chosen", "rejected", "rejected_category", "generation_route", provenance.alias("provenance"))


def pair_report(pairs: DataFrame, target: int, wrong_share: float) -> DataFrame:
    """One row of counts and shares of the selected pairs."""
    one = pairs.agg(
        F.count("*").alias("num_pairs"),
        F.coalesce(F.sum(F.col("rejected_category").isin(MALFORMED).cast("bigint")), F.lit(0)).alias("malformed"),
        F.coalesce(F.sum((F.col("rejected_category") == "wrong_value").cast("bigint")), F.lit(0)).alias("wrong_value"),
    )
    share = lambda c: F.when(F.col("num_pairs") > 0, F.col(c) / F.col("num_pairs")).otherwise(0.0)
    short = F.greatest(F.lit(0), F.ceil(F.col("num_pairs") * wrong_share) - F.col("wrong_value")).cast("bigint")
    return one.select("num_pairs", F.greatest(F.lit(0), F.lit(target) - F.col("num_pairs")).cast("bigint").alias("pair_shortfall"), share("malformed").alias("malformed_fraction"), share("wrong_value").alias("wrong_value_fraction"), short.alias("wrong_value_shortfall"))


def counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))
