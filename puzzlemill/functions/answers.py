"""Native column functions over responses: tags, truncation, keys, prompts, rewards, buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The answer tag, error classes and reward sizes that results must equal.
COMPLETE_TAG = r"(?is)<answer>\s*(.*?)\s*</answer>"
START_TAG = r"(?is)<answer(?=\s|>|$)"
ERRORS = ("missing_answer_tag", "invalid_expression", "number_mismatch", "wrong_value")
FORMAT_REWARD, ANSWER_REWARD = 0.2, 1.0
LENGTH_REASONS = ("length", "max_tokens")
_MARK = "\x01"


def _bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a lambda variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def answer_text(text: Column, compat: str = "v2") -> Column:
    """The answer of a response, or null.

    v2: the last start tag must itself begin a complete tag.  v1: the last
    complete tag counts, whatever follows it.
    """
    found = F.regexp_extract_all(text, F.lit(COMPLETE_TAG), F.lit(0))

    def last(all_tags: Column) -> Column:
        full = F.get(all_tags, F.size(all_tags) - 1)
        inner = F.regexp_extract(full, COMPLETE_TAG, 1)
        if compat == "v1":
            return F.when(F.size(all_tags) > 0, inner)
        tail = F.substring_index(F.regexp_replace(text, COMPLETE_TAG, _MARK), _MARK, -1)
        whole = (F.regexp_count(full, F.lit(START_TAG)) == 1) & (F.regexp_count(tail, F.lit(START_TAG)) == 0)
        return F.when((F.size(all_tags) > 0) & whole, inner)

    return _bind(found, last)


def has_answer(text: Column, compat: str = "v2") -> Column:
    return answer_text(text, compat).isNotNull()


def plain_response(text: Column) -> Column:
    """Line ends as newlines, outer white space gone."""
    return F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"^\s+|\s+$", "")


def is_truncated(finish_reason: Column, token_count: Column, cap: int) -> Column:
    """A length reason says so; any other reason denies it; else the token count decides."""
    by_reason = F.lower(finish_reason).isin(*LENGTH_REASONS)
    return F.when(finish_reason.isNotNull(), by_reason).otherwise(F.coalesce(token_count >= cap, F.lit(False)))


def truncation_evidence(finish_reason: Column, token_count: Column, stop_reason: Column, cap: int) -> Column:
    """struct(truncated, source): v1 also lets a stop reason outweigh the token count."""
    none = finish_reason.isNull() & token_count.isNull() & stop_reason.isNull()
    by_reason = F.coalesce(F.lower(finish_reason).isin(*LENGTH_REASONS), F.lit(False))
    by_count = F.coalesce(token_count >= cap, F.lit(False)) & finish_reason.isNull() & stop_reason.isNull()
    source = F.when(none, "unavailable").when(by_reason, "finish_reason").when(by_count, "token_count").otherwise("metadata")
    return F.struct((by_reason | by_count).alias("truncated"), source.alias("source"))


def ends_in_cap(ids: Column, cap: int, eos: list[int]) -> Column:
    """Generated ids reach the cap without any end token."""
    return (F.size(ids) >= cap) & ~F.arrays_overlap(ids, F.array(*[F.lit(e) for e in eos]).cast("array<bigint>"))


def trim_to_eos(ids: Column, eos: int) -> Column:
    """Ids up to the first end token, that one included."""
    at = F.array_position(ids, F.lit(eos).cast("bigint"))
    return F.when(at > 0, F.slice(ids, F.lit(1), at.cast("int"))).otherwise(ids)


def stable_key(seed: int | str, *parts: Column) -> Column:
    """Hexadecimal order key; the same in any engine that has sha-256."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]), 256)


def request_seed(seed: int, stage: str, source: Column, index: Column) -> Column:
    """First four bytes of a sha-256, big end first."""
    key = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.lit(stage), source.cast("string"), index.cast("string")), 256)
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint")


def row_id(kind: str, position: Column) -> Column:
    return F.format_string(f"{kind}-%06d", position.cast("bigint"))


def numbers_text(numbers: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(numbers, lambda x: x.cast("string")), ", "), F.lit("]"))


# Prompts, word by word.
def solution_prompt(numbers: Column, target: Column) -> Column:
    return F.concat(
        F.lit("Using the numbers "),
        numbers_text(numbers),
        F.lit(", create an equation that equals "),
        target.cast("string"),
        F.lit(".\nUse each number exactly once. Only use +, -, *, / and parentheses.\nDo not use any other numbers. Keep the response concise.\nFinally return <answer> equation </answer>."),
    )


def forced_wrong_prompt(numbers: Column, target: Column, chosen: Column) -> Column:
    t = target.cast("string")
    return F.concat(
        F.lit("Using the numbers "),
        numbers_text(numbers),
        F.lit(", create a plausible but mathematically wrong answer for "),
        t,
        F.lit(".\nUse the same numbers exactly once. Only use +, -, *, / and parentheses.\nThe expression must be parseable and evaluate to a value different from "),
        t,
        F.lit(".\nReturn a complete <answer> expression </answer> block.\nDo not mention that the response is intentionally wrong.\nImitate the style and brevity of this response:\n"),
        chosen,
    )


def user_message(prompt: Column) -> Column:
    return F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content")))


def completion_text(messages: Column) -> Column:
    """The contents of messages, one a line, outer white space gone."""
    return F.regexp_replace(F.array_join(F.transform(messages, lambda m: m["content"]), "\n"), r"^\s+|\s+$", "")


def bucket(numbers: Column, expression: Column, depth: Column) -> Column:
    """Difficulty of a solved puzzle."""
    n, length = F.size(numbers), F.length(expression)
    division, subtraction = F.contains(expression, F.lit("/")), F.contains(expression, F.lit("-"))
    points = [(n >= 4, 1), (n >= 5, 2), (subtraction, 1), (division, 2), (depth >= 4, 1), (length >= 18, 1)]
    score = sum((F.when(c, p).otherwise(0) for c, p in points), F.lit(0))
    level = F.when(score <= 1, "easy").when(score <= 3, "medium").otherwise("hard")
    return F.struct(
        n.cast("bigint").alias("num_count"),
        depth.cast("bigint").alias("expr_depth"),
        length.cast("bigint").alias("expr_len"),
        division.alias("has_division"),
        subtraction.alias("has_subtraction"),
        score.cast("bigint").alias("score"),
        level.alias("complexity"),
        F.concat_ws("_", n.cast("string"), level).alias("bucket_key"),
    )


def rule_reward(format_ok: Column, correct: Column, format_reward: float = FORMAT_REWARD, answer_reward: float = ANSWER_REWARD) -> Column:
    return F.when(format_ok, F.lit(float(format_reward))).otherwise(0.0) + F.when(correct, F.lit(float(answer_reward))).otherwise(0.0)


def length_penalty(tokens: Column, cap: int, start: int, most: float) -> Column:
    """0 up to ``start`` tokens, then a ramp down to ``most`` (negative) at the cap."""
    if most >= 0 or start >= cap:
        return F.lit(0.0)
    share = (tokens - start) / F.lit(float(cap - start))
    # least and greatest skip nulls, so a missing count is asked for by itself
    return F.when(tokens.isNull() | (tokens <= start), 0.0).otherwise(F.lit(most) * F.least(F.lit(1.0), share))


def checkpoint_number(name: Column) -> Column:
    """Trailing digits of a checkpoint's name; -1 without any."""
    digits = F.regexp_extract(name, r"(\d+)\D*$", 1)
    return F.when(digits == "", -1).otherwise(digits.try_cast("bigint"))


def reduced_fraction(text: Column) -> Column:
    """Is the text a fraction n/d in lowest terms with d > 0?"""
    shaped = F.rlike(text, F.lit(r"^(0|-?[1-9][0-9]*)/[1-9][0-9]*$"))
    pair = F.struct(F.abs(F.substring_index(text, "/", 1).try_cast("bigint")).alias("a"), F.substring_index(text, "/", -1).try_cast("bigint").alias("b"))
    # Euclid in bounded steps: 64-bit numbers need at most 92
    state = F.aggregate(F.sequence(F.lit(1), F.lit(92)), pair, lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.when(s["b"] == 0, s["a"]).otherwise(s["a"] % s["b"]).alias("b"))))
    return F.coalesce(shaped & (state["a"] == 1), F.lit(False))
