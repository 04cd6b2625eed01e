"""Column functions and exact arithmetic on known cases."""

import hashlib

import pytest
from pyspark.sql import functions as F

from puzzlemill.functions import answers as A
from puzzlemill.functions.arithmetic import check, evaluate, expression_depth, solve, solve_puzzle


@pytest.mark.parametrize(
    ("expression", "numbers", "target", "ok", "value", "error"),
    [
        ("(85-(45/(69-74)))", [85, 45, 69, 74], 94, True, "94/1", None),
        ("True", [1], 1, False, None, "invalid_expression"),
        ("1.5", [1], 1, False, None, "invalid_expression"),
        ("-1", [1], 1, False, None, "invalid_expression"),
        ("2**3", [2, 3], 8, False, None, "invalid_expression"),
        ("abs(1)", [1], 1, False, None, "invalid_expression"),
        ("1/0", [1, 0], 1, False, None, "invalid_expression"),
        ("((1", [1], 1, False, None, "invalid_expression"),
        ("(7-3)*6", [7, 3, 8, 2], 24, False, "24/1", "number_mismatch"),
        ("(7-3)*(8-2)", [7, 3, 8, 2], 25, False, "24/1", "wrong_value"),
        ("1/2", [1, 2], 3, False, "1/2", "wrong_value"),
        (None, [1], 1, False, None, "missing_answer_tag"),
    ],
)
def test_check(expression, numbers, target, ok, value, error):
    got = check(expression, numbers, target)
    assert (got[0], got[1], got[4]) == (ok, value, error)


def test_v1_hides_fractions():
    assert check("1/2", [1, 2], 3, "v1")[1] is None and check("4/2", [4, 2], 3, "v1")[1] == "2/1"


def test_solver():
    hit = solve((3, 3, 8, 8), 24)
    assert evaluate(hit)[0] == 24 and sorted(evaluate(hit)[1]) == [3, 3, 8, 8]
    assert solve((1, 1), 3) is None and solve((), 1) is None
    assert solve((2, 3), 5) == "(2+3)" and solve((2, 3), 1) == "(3-2)"


def test_solver_column_ignores_the_order_of_numbers(spark):
    df = spark.createDataFrame([([8, 3, 8, 3], 24), ([3, 8, 3, 8], 24), ([1, 1], 3)], "n array<long>, t long")
    got = [r[0] for r in df.select(solve_puzzle("n", "t")).collect()]
    assert got[0] == got[1] is not None and got[2] is None


TAGS = [
    ("<answer> 1+1 </answer>", "1+1", "1+1"),
    ("<answer> 1+1 </answer> then <answer> (7-3)", None, "1+1"),
    ("<answer>a</answer> <ANSWER>\n b\n</ANSWER> tail", "b", "b"),
    ("no tag", None, None),
    ("<answers>x</answers>", None, None),
    ("<answer x <answer>2</answer>", "2", "2"),
    ("<answer></answer>", "", ""),
    (None, None, None),
]


def test_answer_text(spark):
    df = spark.createDataFrame([(t,) for t, *_ in TAGS], "t string")
    got = [tuple(r) for r in df.select(A.answer_text(F.col("t")), A.answer_text(F.col("t"), "v1")).collect()]
    assert got == [(a, b) for _, a, b in TAGS]


def test_answer_rule_against_a_direct_statement(spark):
    import random
    import re

    rng = random.Random(9)
    parts = ["<answer>", "</answer>", "<ANSWER>", "<answer ", "x", " ", "\n", "1+2", "<", "answer>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(1500)]

    def rule(t):
        starts = [m.start() for m in re.finditer(r"(?i)<answer(?=\s|>|$)", t)]
        whole = {m.start(): m.group(1).strip() for m in re.finditer(r"(?is)<answer>\s*(.*?)\s*</answer>", t)}
        return whole.get(starts[-1]) if starts else None

    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(A.answer_text(F.col("t"))).collect()]
    assert [(t, g) for t, g in zip(texts, got, strict=True) if g != rule(t)] == []


def test_buckets(spark):
    gold = "(100+((75/(23-15))+6))"
    df = spark.createDataFrame([([100, 75, 23, 15, 6], gold)], "n array<long>, e string")
    b = df.select(A.bucket(F.col("n"), F.col("e"), expression_depth("e")).alias("b")).first().b
    assert (b.expr_depth, b.bucket_key, b.has_division, b.has_subtraction) == (5, "5_hard", True, True)


def test_keys_and_seeds(spark):
    df = spark.createDataFrame([("a", 3)], "s string, i long")
    r = df.select(A.stable_key(7, F.col("s"), F.col("i")), A.request_seed(7, "t", F.col("s"), F.col("i")), A.row_id("train", F.col("i"))).first()
    assert r[0] == hashlib.sha256(b"7|a|3").hexdigest()
    assert r[1] == int.from_bytes(hashlib.sha256(b"7|t|a|3").digest()[:4], "big") and r[2] == "train-000003"


def test_truncation(spark):
    rows = [("length", 1, None, True, "finish_reason"), ("stop", 99, None, False, "metadata"), (None, 99, None, True, "token_count"), (None, 3, None, False, "metadata"), (None, 99, "x", True, "metadata"), (None, None, None, False, "unavailable"), ("MAX_TOKENS", None, None, True, "finish_reason")]
    df = spark.createDataFrame([r[:3] for r in rows], "f string, n long, s string")
    got = df.select(A.is_truncated(F.col("f"), F.col("n"), 64), A.truncation_evidence(F.col("f"), F.col("n"), F.col("s"), 64).alias("e")).collect()
    assert [(g[0], g.e.source) for g in got] == [(r[3], r[4]) for r in rows]


def test_rewards_and_penalties(spark):
    df = spark.createDataFrame([(True, True, 10), (False, False, None), (True, False, 100), (True, False, 60)], "f boolean, c boolean, n long")
    got = [tuple(r) for r in df.select(A.rule_reward(F.col("f"), F.col("c")), A.length_penalty(F.col("n"), 100, 20, -0.5)).collect()]
    assert got == [pytest.approx(x) for x in [(1.2, 0.0), (0.0, 0.0), (0.2, -0.5), (0.2, -0.25)]]


def test_small_functions(spark):
    df = spark.createDataFrame([("checkpoint-120", "3/4", [1, 2, 9, 4], "  a\r\nb\r ")], "n string, f string, ids array<long>, t string")
    r = df.select(A.checkpoint_number(F.col("n")), A.checkpoint_number(F.lit("x")), A.reduced_fraction(F.col("f")), A.reduced_fraction(F.lit("2/4")), A.reduced_fraction(F.lit("0/1")), A.trim_to_eos(F.col("ids"), 9), A.trim_to_eos(F.col("ids"), 7), A.ends_in_cap(F.col("ids"), 4, [7]), A.plain_response(F.col("t"))).first()
    assert tuple(r) == (120, -1, True, False, True, [1, 2, 9], [1, 2, 9, 4], True, "a\nb")


def test_prompts(spark):
    df = spark.createDataFrame([([3, 7], 10, "ok")], "n array<long>, t long, c string")
    a, b = df.select(A.solution_prompt(F.col("n"), F.col("t")), A.forced_wrong_prompt(F.col("n"), F.col("t"), F.col("c"))).first()
    assert a.startswith("Using the numbers [3, 7], create an equation that equals 10.\n") and a.endswith("Finally return <answer> equation </answer>.")
    assert "wrong answer for 10.\n" in b and b.endswith("response:\nok")
