"""Shaping and validation of records, and token masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions.arithmetic import check_expression, expression_depth, solve_puzzle
from .checks import require
from .preferences import CATEGORIES, ROUTES


def number_list(df: DataFrame, prefer: str = "nums") -> Column:
    """The numbers column, whichever name it has, as array<bigint>; JSON text is parsed."""
    names = [prefer, "numbers" if prefer == "nums" else "nums"]
    have = [n for n in names if n in df.columns]
    if not have:
        raise ValueError("no column of numbers")
    parts = []
    for n in have:
        text = dict(df.dtypes)[n] == "string"
        parts.append(F.from_json(F.col(n), "array<bigint>") if text else F.col(n).cast("array<bigint>"))
    return F.coalesce(*parts)


def require_numbers(df: DataFrame, prefer: str = "nums") -> DataFrame:
    """``df``, failing on rows whose numbers are no filled list of whole numbers from 0, or whose target is none.

    JSON text must be such a list as it stands; fractions are refused, not cut.
    """
    kinds = dict(df.dtypes)
    for name in [n for n in (prefer, "numbers" if prefer == "nums" else "nums") if n in kinds]:
        value = F.col(name)
        if kinds[name] == "string":
            ok = F.rlike(value, F.lit(r"^\s*\[\s*\d+(\s*,\s*\d+)*\s*\]\s*$"))
        else:
            whole = lambda x: F.coalesce((x >= 0) & (x == F.floor(x)), F.lit(False))
            ok = (F.size(value) > 0) & F.forall(value, whole)
        df = require(df, value.isNull() | F.coalesce(ok, F.lit(False)), f"{name} must be a filled list of whole numbers")
    df = require(df, F.coalesce(F.size(number_list(df, prefer)) > 0, F.lit(False)), "a row has no numbers")
    target = F.col("target")
    return require(df, F.coalesce((target >= 0) & (target == F.floor(target)), F.lit(False)), "target must be a whole number")


def normalize(df: DataFrame, kind: str, position: str, prefer: str = "nums", strict: bool = False) -> DataFrame:
    """(id, source_index, numbers, target) of raw rows with a 1-based position.

    ``strict`` fails on numbers and targets that are none; else they become null and the row unsolved.
    """
    df = require_numbers(df, prefer) if strict else df
    return df.select(A.row_id(kind, F.col(position)).alias("id"), F.col(position).cast("bigint").alias("source_index"), number_list(df, prefer).alias("numbers"), F.col("target").cast("bigint").alias("target"))


def solve(df: DataFrame) -> DataFrame:
    """Adds gold_expr, null if there is none.  Each distinct puzzle is solved once; no row is lost, also not those with nulls."""
    keyed = df.withColumn("_sorted", F.array_sort("numbers"))
    puzzles = keyed.select(F.col("_sorted").alias("_s"), F.col("target").alias("_t")).distinct().withColumn("gold_expr", solve_puzzle("_s", "_t"))
    same = keyed["_sorted"].eqNullSafe(puzzles["_s"]) & keyed["target"].eqNullSafe(puzzles["_t"])
    return keyed.join(puzzles, same, "left").drop("_sorted", "_s", "_t")


def source_records(solved: DataFrame) -> DataFrame:
    """Solved rows with prompt and bucket."""
    rows = solved.where("gold_expr is not null").withColumn("_depth", expression_depth("gold_expr"))
    return rows.select("id", "source_index", "numbers", "target", "gold_expr", A.solution_prompt(F.col("numbers"), F.col("target")).alias("prompt"), A.bucket(F.col("numbers"), F.col("gold_expr"), F.col("_depth")).alias("bucket"))


def unsolved_records(solved: DataFrame) -> DataFrame:
    """The other rows, each with a reason."""
    whole = F.col("target").isNotNull() & (F.size(F.coalesce("numbers", F.array().cast("array<bigint>"))) > 0) & ~F.exists("numbers", lambda x: x.isNull())
    reason = F.when(F.coalesce(whole, F.lit(False)), "no_solution").otherwise("invalid_puzzle")
    return solved.where("gold_expr is null").select("id", "source_index", "numbers", "target", reason.alias("reason"))


def validated(df: DataFrame, response: str = "response", compat: str = "v2") -> DataFrame:
    """Adds ``validation``; responses without an answer never reach Python."""
    rows = df.withColumn("_expression", A.answer_text(F.col(response), compat))
    checked = F.when(F.col("_expression").isNotNull(), check_expression(F.col("_expression"), F.col("numbers"), F.col("target")))
    missing = F.struct(F.lit(False).alias("ok"), F.lit(None).cast("string").alias("value"), F.array().cast("array<bigint>").alias("used_numbers"), F.lit(None).cast("string").alias("expression"), F.lit("missing_answer_tag").alias("error"))
    return rows.withColumn("validation", F.when(F.col("_expression").isNull(), missing).otherwise(checked)).drop("_expression")


def eval_samples(df: DataFrame) -> DataFrame:
    """Scored rows of an evaluation; takes id, prompt, response, numbers, target, generated_tokens, truncated."""
    v = F.col("validation")
    rows = validated(df)
    return rows.select(
        *[c for c in rows.columns if c not in ("validation", "response")],
        F.col("response").alias("raw_generation"),
        v["expression"].alias("extracted_expr"),
        v["expression"].isNotNull().alias("format_ok"),
        (~F.coalesce(v["error"].isin("missing_answer_tag", "invalid_expression"), F.lit(False))).alias("valid_expression"),
        v["ok"].alias("correct"),
        v["error"].alias("error"),
        v["value"].alias("value"),
    )


def training_record(source: DataFrame, data_source: str = "countdown", ability: str = "math") -> DataFrame:
    """Nested records for a reinforcement trainer."""
    return source.select(
        F.lit(data_source).alias("data_source"),
        A.user_message(F.col("prompt")).alias("prompt"),
        F.lit(ability).alias("ability"),
        F.struct(F.lit("rule").alias("style"), F.struct("numbers", "target").alias("ground_truth")).alias("reward_model"),
        F.struct("id", "source_index", "bucket", "gold_expr").alias("extra_info"),
    )


def teacher_payload(df: DataFrame, generator: str, response: str = "response") -> DataFrame:
    """Rows with a stripped response, its validation and where it came from."""
    rows = validated(df.withColumn(response, F.regexp_replace(response, r"^\s+|\s+$", "")), response)
    return rows.withColumn("provenance", F.struct(F.lit(generator).alias("generator"), F.lit("teacher").alias("stage"), F.lit(0).cast("bigint").alias("rollout_index")))


def rule_scores(df: DataFrame, solution: str = "solution", known: str = "countdown") -> DataFrame:
    """Adds ``score`` struct(score, format_ok, answer_correct, error, expression, value) to a trainer's rows.

    Takes data_source and reward_model; rows of another source score 0 with an error of their own.
    """
    truth = F.col("reward_model.ground_truth")
    rows = df.withColumn("_numbers", truth["numbers"]).withColumn("_target", truth["target"])
    checked = validated(rows.withColumnsRenamed({c: f"_own_{c}" for c in ("numbers", "target", "validation") if c in rows.columns}).withColumnsRenamed({"_numbers": "numbers", "_target": "target"}), solution)
    v, mine = F.col("validation"), F.col("data_source") == known
    formed, right = v["expression"].isNotNull(), v["ok"]
    score = F.struct(
        F.when(mine, A.rule_reward(formed, right)).otherwise(0.0).alias("score"),
        F.coalesce(mine & formed, F.lit(False)).alias("format_ok"),
        F.coalesce(mine & right, F.lit(False)).alias("answer_correct"),
        F.when(mine, v["error"]).otherwise("unsupported_data_source").alias("error"),
        F.when(mine, v["expression"]).alias("expression"),
        F.when(mine, v["value"]).alias("value"),
    )
    return checked.withColumn("score", score).drop("validation", "numbers", "target").withColumnsRenamed({f"_own_{c}": c for c in ("numbers", "target", "validation") if c in df.columns})


def combined_rewards(df: DataFrame, cap: int, start: int, most: float, format_reward: float = A.FORMAT_REWARD, answer_reward: float = A.ANSWER_REWARD) -> DataFrame:
    """v1: adds reward (form, answer and length together), format_ok and correct; takes completion, numbers, target, token_count."""
    checked = validated(df.drop("validation"), "completion", "v1")
    formed, right = F.col("validation.expression").isNotNull(), F.col("validation.ok")
    reward = A.rule_reward(formed, right, format_reward, answer_reward) + A.length_penalty(F.col("token_count"), cap, start, most)
    return checked.withColumn("reward", reward).withColumn("format_ok", formed).withColumn("correct", right).drop("validation")


def preference_triple(pairs: DataFrame) -> DataFrame:
    """(prompt, chosen, rejected), failing on an empty one."""
    filled = [F.coalesce(F.length(F.btrim(c)) > 0, F.lit(False)) for c in ("prompt", "chosen", "rejected")]
    return require(pairs, filled[0] & filled[1] & filled[2], "a pair has an empty text").select("prompt", "chosen", "rejected")


def message_record(rows: DataFrame, with_answer: bool = False) -> DataFrame:
    """prompt as messages and the text kept as source_prompt; or whole conversations as ``messages``."""
    if with_answer:
        both = F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("response").alias("content")))
        return rows.withColumn("messages", both)
    return rows.withColumn("source_prompt", F.col("prompt")).withColumn("prompt", A.user_message(F.col("source_prompt")))


def source_columns(sft: DataFrame) -> DataFrame:
    return sft.select("id", "source_index", "numbers", "target", "gold_expr", "prompt", "bucket")


# --- validation: a list of violations beside each row -----------------------


def _violations(*rules: tuple[str, Column]) -> Column:
    return F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules]), lambda x: x.isNotNull())


def _filled(column: str) -> Column:
    return F.length(column) > 0


def source_violations(rows: DataFrame) -> DataFrame:
    """Adds violations; prompt, solution and bucket are recomputed and compared."""
    rows = rows.withColumn("_check", check_expression("gold_expr", "numbers", "target")).withColumn("_depth", expression_depth("gold_expr"))
    own = A.bucket(F.col("numbers"), F.col("gold_expr"), F.col("_depth"))
    rules = [
        ("id", _filled("id")),
        ("source_index", F.col("source_index") >= 0),
        ("numbers", (F.size("numbers") > 0) & ~F.exists("numbers", lambda x: x.isNull() | (x < 0))),
        ("target", F.col("target") >= 0),
        ("prompt", F.col("prompt") == A.solution_prompt(F.col("numbers"), F.col("target"))),
        ("gold_expr", F.col("_check.ok")),
        ("bucket", F.col("bucket") == own),
    ]
    return rows.withColumn("violations", _violations(*rules)).drop("_check", "_depth")


def sft_violations(rows: DataFrame) -> DataFrame:
    """Adds violations; the declared validation must equal the recomputed one and be a success."""
    again = validated(rows.withColumnRenamed("validation", "_declared"))
    rules = [("response", _filled("response")), ("validation", F.col("_declared") == F.col("validation")), ("correct", F.col("validation.ok")), ("provenance", F.col("provenance").isNotNull())]
    return again.withColumn("violations", _violations(*rules)).drop("validation").withColumnRenamed("_declared", "validation")


def pair_violations(rows: DataFrame) -> DataFrame:
    rules = [
        *[(c, _filled(c)) for c in ("prompt", "chosen", "rejected")],
        ("different", F.col("chosen") != F.col("rejected")),
        ("rejected_category", F.col("rejected_category").isin(CATEGORIES)),
        ("generation_route", F.col("generation_route").isin(ROUTES)),
    ]
    return rows.withColumn("violations", _violations(*rules))


def training_violations(rows: DataFrame) -> DataFrame:
    numbers = F.col("reward_model.ground_truth.numbers")
    rules = [
        ("data_source", F.col("data_source") == "countdown"),
        ("ability", F.col("ability") == "math"),
        ("prompt", (F.size("prompt") == 1) & ~F.exists("prompt", lambda m: (m["role"] != "user") | (F.length(m["content"]) == 0))),
        ("style", F.col("reward_model.style") == "rule"),
        ("ground_truth", (F.size(numbers) > 0) & ~F.exists(numbers, lambda x: x.isNull() | (x < 0))),
        ("target", F.col("reward_model.ground_truth.target") >= 0),
        ("id", _filled("extra_info.id")),
        ("source_index", F.col("extra_info.source_index") >= 0),
        ("bucket", F.length("extra_info.bucket.bucket_key") > 0),
    ]
    return rows.withColumn("violations", _violations(*rules))


def violation_report(rows: DataFrame) -> DataFrame:
    """(violation, n) over rows with violations."""
    return rows.select(F.explode("violations").alias("violation")).groupBy("violation").agg(F.count("*").alias("n"))


# --- token masks ---------------------------------------------------------------


def supervised_masks(rows: DataFrame, most: int, pad: int, ignore: int = -100) -> DataFrame:
    """input_ids, labels and attention_mask of fixed length from prompt_ids and full_ids.

    The prompt must be a prefix of the whole; its labels are ignored.
    """
    whole = F.slice("full_ids", F.lit(1), F.lit(most))
    is_prefix = F.slice("full_ids", F.lit(1), F.size("prompt_ids")) == F.col("prompt_ids")
    hidden = F.least(F.size("prompt_ids"), F.size(whole))
    labels = F.concat(F.array_repeat(F.lit(ignore).cast("bigint"), hidden), F.slice(whole, hidden + 1, F.size(whole) - hidden))
    gap = F.lit(most) - F.size(whole)
    rows = rows.where(F.when(is_prefix, F.lit(True)).otherwise(F.raise_error(F.lit("the prompt is no prefix of its conversation")).cast("boolean")))
    return rows.select(
        "*",
        F.concat(whole, F.array_repeat(F.lit(pad).cast("bigint"), gap)).alias("input_ids"),
        F.concat(labels, F.array_repeat(F.lit(ignore).cast("bigint"), gap)).alias("labels"),
        F.concat(F.array_repeat(F.lit(1), F.size(whole)), F.array_repeat(F.lit(0), gap)).alias("attention_mask"),
    )


def policy_ids(rows: DataFrame, most_prompt: int, most_new: int) -> DataFrame:
    """The last prompt ids and the first completion ids; rows without either are dropped."""
    size = F.size("prompt_ids")
    keep = F.least(size, F.lit(most_prompt))
    prompt = F.slice("prompt_ids", size - keep + 1, keep)
    out = rows.where((size > 0) & (F.size("completion_ids") > 0))
    return out.withColumn("prompt_ids", prompt).withColumn("completion_ids", F.slice("completion_ids", F.lit(1), F.lit(most_new)))
