"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target number of words by water filling: shares follow the
weights, a share stops at ``cap`` times the source's size and the excess is
shared again by weight.  Every document of a source then has the same expected
number of copies; its fractional part is made integral by pivotal rounding.
Two fractional documents exchange words (one gains what the other loses, which
way is drawn so that both expectations hold) until one of them is integral.
Blocks of documents are folded independently, each leaves one fractional
residual, and the residuals are folded again, level by level: a reduction tree
whose groups never hold more than a block.

Documents larger than ``big`` of their source and than half its mean (at most
1/``big`` of them exist) are rounded first; the words they miss or exceed are spread over the rest of
the source, so one long document cannot move a source from its target.

Defined results: null or blank text has size 0 and takes 0; texts of any length
are counted whole; equal rows are numbered, so ties have an order; a null source is a
source of its own, last in order; repeated rows are rounded one by one; a null
doc_id is a value like any other; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, SPACE_RUN, checkpoint, let, pick, unit

BLOCK = 64
ITEM = "struct<id:bigint,size:bigint,base:bigint,p:double>"
DONE = "struct<id:bigint,size:bigint,copies:bigint>"
STATE = f"struct<held:{ITEM},done:array<{DONE}>>"
TINY = 1e-9


def word_count(text: Column) -> Column:
    """Number of maximal non-space runs: starts of words after each space run."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(F.length(t) == 0, F.lit(0)).otherwise(F.regexp_count(t, F.lit(SPACE_RUN)) + 1).cast("bigint")


def source_targets(sizes: DataFrame, share: float = 1.5, weights: tuple[int, ...] = (3, 1, 2), cap: float = 2.0) -> DataFrame:
    """(source, source_size, target, n_rows) for rows (source, size); one row per source.

    The level of the water is the same for every source below its cap, so the
    sources are ordered by cap / weight and the first prefix of capped sources
    that leaves all others below their caps is the answer.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    # a catalogue of sources: one row per source, summed before it meets in one task
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    s = s.withColumn("weight", F.get(cycle, (F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1) % len(weights)))
    s = s.withColumn("cap", F.col("source_size") * F.lit(cap))
    everything = W.partitionBy()
    order = W.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    s = (
        s.withColumn("total", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("left_words", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left_words") / F.col("left_weight"))
        .withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
        .withColumn("water", F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    )
    filled = F.least(F.col("cap"), F.coalesce(F.col("water") * F.col("weight"), F.col("cap")))
    return s.select("source", "source_size", filled.alias("target"), "n_rows")


def _fold(items: Column, seed: int) -> Column:
    """Pivotal rounding of an ordered array of fractional items."""

    def item(x: Column, p: Column) -> Column:
        p = F.when(p < TINY, F.lit(0.0)).when(p > 1 - TINY, F.lit(1.0)).otherwise(p)
        return F.struct(x["id"].alias("id"), x["size"].alias("size"), x["base"].alias("base"), p.alias("p")).cast(ITEM)

    def whole(x: Column) -> Column:
        return (x["p"] == 0) | (x["p"] == 1)

    def settled(x: Column) -> Column:
        return F.struct(x["id"].alias("id"), x["size"].alias("size"), (x["base"] + x["p"].cast("bigint")).alias("copies")).cast(DONE)

    def step(state: Column, b: Column) -> Column:
        a = state["held"]
        gain = F.least((1 - a["p"]) * a["size"], b["p"] * b["size"])  # words that a can win from b
        lose = F.least(a["p"] * a["size"], (1 - b["p"]) * b["size"])
        moved = F.when(unit(F.lit(seed), a["id"], b["id"], a["size"], b["size"]) * (gain + lose) < lose, gain).otherwise(-lose)
        pair = F.array(item(a, a["p"] + moved / a["size"]), item(b, b["p"] - moved / b["size"]))
        met = let(
            pair,
            lambda two: F.struct(
                F.get(F.filter(two, lambda x: ~whole(x)), F.lit(0)).alias("held"),
                F.concat(state["done"], F.transform(F.filter(two, whole), settled)).alias("done"),
            ).cast(STATE),
        )
        return F.when(a.isNull(), F.struct(b.cast(ITEM).alias("held"), state["done"].alias("done")).cast(STATE)).otherwise(met)

    start = F.struct(F.lit(None).cast(ITEM).alias("held"), F.array().cast(f"array<{DONE}>").alias("done")).cast(STATE)
    return F.aggregate(items, start, step)


def _round_tree(items: DataFrame, n: int, seed: int) -> DataFrame:
    """(source, id, size, copies) for rows (source, id, size, base, p, nth) with 0 < p < 1; about n rows.

    ``nth`` tells equal items apart, so that they too are dealt over all blocks.
    """
    parts, level, blocks = [], 0, max(1, -(-n // BLOCK))
    while True:
        block = F.pmod(F.xxhash64(F.lit(seed + level), "id", "size", "nth"), F.lit(blocks)).alias("block")
        drawn = F.struct(unit(F.lit(seed - level), "id", "size", "nth").alias("u"), "id", "size", "base", "p")
        rows = items.groupBy("source", block).agg(F.sort_array(F.collect_list(drawn)).alias("items"))
        ordered = F.transform("items", lambda x: F.struct(x["id"].alias("id"), x["size"].alias("size"), x["base"].alias("base"), x["p"].alias("p")))
        folded = checkpoint(rows.select("source", "block", _fold(ordered, seed + level).alias("f")))  # read twice below
        parts.append(folded.select("source", F.inline("f.done")))
        items = folded.where("f.held is not null").select("source", "f.held.id", "f.held.size", "f.held.base", "f.held.p", F.col("block").alias("nth"))
        if blocks == 1:  # the one residual of a source: to the nearer side
            parts.append(items.select("source", "id", "size", (F.col("base") + F.round("p")).cast("bigint").alias("copies")))
            break
        level, blocks = level + 1, blocks // BLOCK or 1
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _rounded(rows: DataFrame, per_word: Column, cap: float, n: int, seed: int) -> DataFrame:
    """(source, id, size, copies): whole copies, and the fractional part by the tree."""
    f = F.least(F.lit(cap), F.greatest(F.lit(0.0), per_word))
    base = F.floor(F.col("f") + TINY).cast("bigint")
    rows = rows.select("source", F.col("doc_id").alias("id"), "size", f.alias("f"))
    rows = rows.withColumn("base", base).withColumn("p", F.col("f") - F.col("base"))
    whole = rows.where(F.col("p") < TINY).select("source", "id", "size", F.col("base").alias("copies"))
    # equal rows are counted, which partial sums do, and numbered again
    equal = rows.where(F.col("p") >= TINY).groupBy("source", "id", "size").agg(F.count("*").alias("rows"), F.first("base").alias("base"), F.first("p").alias("p"))
    parted = equal.select("source", "id", "size", "base", "p", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("rows"))).alias("nth"))
    return whole.unionByName(_round_tree(parted, n, seed))


def mix_sources(docs: DataFrame, share: float = 1.5, weights: tuple[int, ...] = (3, 1, 2), cap: float = 2.0, big: float = 0.0025, seed: int = 7) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies), a row for each row of ``docs``."""
    d = pick(docs, doc_id="bigint", source="string", text="string")
    # the texts are read once: sizes are all that the rest needs
    sizes = checkpoint(d.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    t = source_targets(sizes, share, weights, cap)
    named = t.select(F.col("source").alias("t_source"), "source_size", "target", "n_rows")
    named = checkpoint(named)
    rows = checkpoint(sizes.where("size > 0").join(named, F.col("source").eqNullSafe(F.col("t_source"))))
    is_big = F.col("size") > F.col("source_size") * F.greatest(F.lit(big), F.lit(0.5) / F.col("n_rows"))

    large = _rounded(rows.where(is_big), F.col("target") / F.col("source_size"), cap, round(1 / big), seed)
    large = checkpoint(large)
    took = large.groupBy(F.col("source").alias("b_source")).agg(F.sum("size").alias("b_size"), F.sum(F.col("copies") * F.col("size")).alias("b_taken"), F.lit(True).alias("found"))
    small = rows.where(~is_big).join(took, F.col("source").eqNullSafe(F.col("b_source")) & F.col("found"), "left")
    rest = (F.col("target") - F.coalesce("b_taken", F.lit(0))) / (F.col("source_size") - F.coalesce("b_size", F.lit(0)))
    small = _rounded(small, rest, cap, sizes.count(), seed + 100)

    empty = sizes.where("size = 0").select("source", F.col("doc_id").alias("id"), "size", F.lit(1).cast("bigint").alias("copies"))
    out = large.unionByName(small).unionByName(empty).join(named, F.col("source").eqNullSafe(F.col("t_source")))
    return out.select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "copies")


def mixed_documents(docs: DataFrame, **options: object) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as its copies say.

    Expects doc_id to identify a row, as in ``documents``.
    """
    copies = mix_sources(docs, **options).select(F.col("doc_id").alias("m_doc_id"), "copies")
    joined = docs.join(copies, F.col("doc_id").eqNullSafe(F.col("m_doc_id")))
    repeated = joined.withColumn("m_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return repeated.select(*[F.col(f"`{c}`") for c in docs.columns])
