"""Preference formatting of conversation pairs.

Chosen and rejected conversations are compared turn by turn (role and text).
Their longest common prefix of turns is rendered once, as the prompt; what
follows on each side is rendered as a completion.  A completion comes with the
character spans that a loss may see, the contents of its assistant turns and
the end marks that follow them; everything else is masked.

A turn is rendered as ``<|im_start|>role`` newline text ``<|im_end|>`` newline.
Marks inside a text are broken up, so that no text can forge a turn.

Defined results: turns of any length are rendered whole; they are ordered by number, then role and text, so ties and
repeated rows have one order; null roles and texts are empty; a pair with one
side only has an empty other side (and no common turns); equal sides have the
whole conversation as prompt and empty completions; rows with a null pair are
dropped; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, pick

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
TURN = "struct<role:string,text:string>"


def conversations(turns: DataFrame, name: str, key: str = "conv_id") -> DataFrame:
    """(key, name): the turns of each conversation as an ordered array."""
    t = pick(turns, **{key: "bigint"}, turn="bigint", role="string", text="string").where(F.col(key).isNotNull())
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = F.transform(F.array_sort(F.collect_list(row)), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")).cast(TURN))
    return t.groupBy(key).agg(ordered.alias(name))


def render(turns: Column) -> Column:
    def safe(x: Column) -> Column:
        return F.replace(F.replace(x, F.lit("<|im_"), F.lit("<| im_")), F.lit("\r"), F.lit(""))

    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), safe(t["role"]), F.lit("\n"), safe(t["text"]), F.lit(CLOSE + "\n"))), "")


def learned_spans(turns: Column) -> Column:
    """[from, to) of the unmasked characters in the rendered turns."""
    state = "struct<at:int,spans:array<struct<from:int,to:int>>>"

    def walk(s: Column, t: Column) -> Column:
        head = F.length(render(F.array(t))) - F.length(F.lit(CLOSE + "\n"))
        begin = s["at"] + F.length(F.lit(OPEN + "assistant\n"))
        end = s["at"] + head + F.length(F.lit(CLOSE))
        spans = F.when(t["role"] == "assistant", F.concat(s["spans"], F.array(F.struct(begin.alias("from"), end.alias("to"))))).otherwise(s["spans"])
        return F.struct((s["at"] + F.length(render(F.array(t)))).alias("at"), spans.alias("spans")).cast(state)

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<from:int,to:int>>").alias("spans")).cast(state)
    return F.aggregate(turns, start, walk)["spans"]


def common_turns(a: Column, b: Column) -> Column:
    """How many first turns are equal."""
    shorter = F.least(F.size(a), F.size(b))
    differ = F.filter(F.when(shorter > 0, F.sequence(F.lit(0), shorter - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.get(a, i) != F.get(b, i))
    return F.coalesce(F.get(differ, F.lit(0)), shorter)


def format_preferences(pairs: DataFrame, *keys: str) -> DataFrame:
    """Rows (keys, prompt_turns, prompt, chosen, rejected, chosen_spans, rejected_spans) for arrays of turns ``chosen`` and ``rejected``."""
    none = F.array().cast(f"array<{TURN}>")
    p = pairs.select(*keys, F.coalesce("chosen", none).alias("a"), F.coalesce("rejected", none).alias("b"))
    p = p.withColumn("n", common_turns(F.col("a"), F.col("b")))
    rest = lambda c: F.slice(c, F.col("n") + 1, F.greatest(F.size(c) - F.col("n"), F.lit(0)))
    p = p.select(*keys, F.col("n").cast("bigint").alias("prompt_turns"), F.slice("a", F.lit(1), F.col("n")).alias("p"), rest("a").alias("a"), rest("b").alias("b"))
    return p.select(*keys, "prompt_turns", render(F.col("p")).alias("prompt"), render(F.col("a")).alias("chosen"), render(F.col("b")).alias("rejected"), learned_spans(F.col("a")).alias("chosen_spans"), learned_spans(F.col("b")).alias("rejected_spans"))


def neighbour_preferences(turns: DataFrame) -> DataFrame:
    """Pairs made from one table: a conversation is chosen, and rejected is what
    remains if its last assistant turn is answered as in the conversation with
    the id that differs in the last bit (or not at all, if there is none).
    """
    own = conversations(turns, "chosen")
    replies = lambda c: F.filter(c, lambda t: t["role"] == "assistant")
    other = own.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.element_at(F.concat(F.array(F.lit(None).cast(TURN)), replies(F.col("chosen"))), -1).alias("reply"))
    both = own.join(other, "conv_id", "left")
    last = F.size("chosen") - F.array_position(F.transform(F.reverse("chosen"), lambda t: t["role"]), "assistant").cast("int")
    before = let(last, lambda k: F.when(F.exists("chosen", lambda t: t["role"] == "assistant"), F.slice("chosen", F.lit(1), k)).otherwise(F.col("chosen")))
    reply = F.when(F.col("reply").isNull() | ~F.exists("chosen", lambda t: t["role"] == "assistant"), F.array().cast(f"array<{TURN}>")).otherwise(F.array("reply"))
    return format_preferences(both.select("conv_id", "chosen", F.concat(before, reply).alias("rejected")), "conv_id")
