"""Exact rational arithmetic over answer expressions, as Arrow-batched functions.

SQL types cannot hold exact fractions of any size, so parsing, evaluation and
search run in Python, a batch at a time, with each distinct input solved once.
"""

from __future__ import annotations

import ast
from collections import Counter
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHECK = (
    T.StructType()
    .add("ok", T.BooleanType())
    .add("value", T.StringType())
    .add("used_numbers", T.ArrayType(T.LongType()))
    .add("expression", T.StringType())
    .add("error", T.StringType())
)


def _apply(op: ast.operator, a: Fraction, b: Fraction) -> Fraction:
    match op:
        case ast.Add():
            return a + b
        case ast.Sub():
            return a - b
        case ast.Mult():
            return a * b
        case ast.Div():
            return a / b
    raise ValueError("operator not allowed")


def evaluate(expression: str) -> tuple[Fraction, list[int]]:
    """Value and numbers, left to right, of an expression of + - * / over whole numbers.

    The tree is walked with an explicit stack, so depth costs no recursion.
    """
    todo: list = [ast.parse(expression.strip(), mode="eval").body]
    values: list[Fraction] = []
    used: list[int] = []
    while todo:
        node = todo.pop()
        if isinstance(node, ast.operator):
            b, a = values.pop(), values.pop()
            values.append(_apply(node, a, b))
        elif isinstance(node, ast.BinOp):
            todo += [node.op, node.right, node.left]
        elif isinstance(node, ast.Constant) and type(node.value) is int:
            values.append(Fraction(node.value))
            used.append(node.value)
        else:
            raise ValueError("form not allowed")
    return values[0], used


def fraction_text(value: Fraction) -> str:
    return f"{value.numerator}/{value.denominator}"


def check(expression: str | None, numbers: list[int], target: int, compat: str = "v2") -> tuple:
    """(ok, value, used_numbers, expression, error): form, then numbers, then value."""
    if expression is None:
        return False, None, [], None, "missing_answer_tag"
    try:
        value, used = evaluate(expression)
    except (SyntaxError, ValueError, ZeroDivisionError, RecursionError, MemoryError):
        return False, None, [], expression, "invalid_expression"
    shown = fraction_text(value) if compat == "v2" or value.denominator == 1 else None
    if Counter(used) != Counter(numbers):
        return False, shown, used, expression, "number_mismatch"
    if value != target:
        return False, shown, used, expression, "wrong_value"
    return True, shown, used, expression, None


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["ok", "value", "used_numbers", "expression", "error"])


def _whole(numbers: object, target: object) -> bool:
    """Neither is null, nor is any of the numbers."""
    return numbers is not None and not pd.isna(target) and not any(pd.isna(x) for x in numbers)


@F.pandas_udf(CHECK)
def _check_text(expression: pd.Series, numbers: pd.Series, target: pd.Series) -> pd.DataFrame:
    bad = lambda e: (False, None, [], e, "invalid_puzzle")
    return _frame([check(e, [int(x) for x in n], int(t)) if _whole(n, t) else bad(e) for e, n, t in zip(expression, numbers, target, strict=True)])


def check_expression(expression: Column | str, numbers: Column | str, target: Column | str) -> Column:
    """Check an expression; a puzzle without numbers or target, or with a null number, is an ``invalid_puzzle``.

    Targets go as text, since a batch of whole numbers with a null would turn to floats.
    """
    return _check_text(expression, numbers, F.col(target).cast("string") if isinstance(target, str) else target.cast("string"))


@F.pandas_udf(T.LongType())
def expression_depth(expression: pd.Series) -> pd.Series:
    """Nesting of operations, a number being 1; 0 for what cannot be parsed."""

    @lru_cache(50_000)
    def depth(text: str) -> int:
        try:
            level, here = 0, [ast.parse(text, mode="eval").body]
        except (SyntaxError, RecursionError, ValueError, MemoryError):
            return 0
        reach = 0
        while here:  # level by level; only numbers end a path with a level of their own
            level += 1
            reach = level if any(isinstance(x, ast.Constant | ast.BinOp) for x in here) else reach
            here = [child for x in here if isinstance(x, ast.BinOp) for child in (x.left, x.right)]
        return reach

    return expression.map(lambda x: depth(x) if x is not None else 0)


def _missing(goal: Fraction, x: Fraction) -> Iterator[tuple[Fraction, str]]:
    """(y, form) of all y that make the goal together with x: {0} stands for x, {1} for y."""
    yield goal - x, "({0}+{1})"
    yield goal + x, "({1}-{0})"
    yield x - goal, "({0}-{1})"
    if x:
        yield goal / x, "({0}*{1})"
        yield goal * x, "({1}/{0})"
        if goal:
            yield x / goal, "({0}/{1})"


class _Puzzle:
    """Expressions over subsets of the numbers, which bit masks name."""

    #: Of so many numbers all values are tabulated; more are asked for one value.
    TABULATED = 3

    def __init__(self, numbers: tuple[int, ...]):
        self.numbers = numbers
        self.tables: dict[int, dict[Fraction, str]] = {1 << i: {Fraction(n): str(n)} for i, n in enumerate(numbers)}
        self.answers: dict[tuple[int, Fraction], str | None] = {}

    @staticmethod
    def parts(mask: int) -> list[int]:
        """Proper subsets of at most half the numbers, small ones first."""
        subset, found = (mask - 1) & mask, []
        while subset:
            if 2 * subset.bit_count() <= mask.bit_count():
                found.append(subset)
            subset = (subset - 1) & mask
        return sorted(found, key=lambda m: (m.bit_count(), m))

    def table(self, mask: int) -> dict[Fraction, str]:
        """Every value that uses all numbers of the mask, each with the first expression found."""
        if mask not in self.tables:
            out: dict[Fraction, str] = {}
            for part in self.parts(mask):
                for x, p in self.table(part).items():
                    for y, q in self.table(mask ^ part).items():
                        made = [(x + y, f"({p}+{q})"), (x - y, f"({p}-{q})"), (y - x, f"({q}-{p})"), (x * y, f"({p}*{q})")]
                        made += [(x / y, f"({p}/{q})")] if y else []
                        made += [(y / x, f"({q}/{p})")] if x else []
                        for value, text in made:
                            out.setdefault(value, text)
            self.tables[mask] = out
        return self.tables[mask]

    def reach(self, mask: int, goal: Fraction) -> str | None:
        """An expression of all numbers of the mask with the value ``goal``."""
        if mask.bit_count() <= self.TABULATED:
            return self.table(mask).get(goal)
        if (mask, goal) not in self.answers:
            self.answers[mask, goal] = self._search(mask, goal)
        return self.answers[mask, goal]

    def _search(self, mask: int, goal: Fraction) -> str | None:
        for part in self.parts(mask):
            rest = mask ^ part
            for x, p in self.table(part).items():
                if not x and not goal:  # nothing times whatever is left
                    return f"({p}*({'+'.join(str(n) for i, n in enumerate(self.numbers) if rest >> i & 1)}))"
                for y, form in _missing(goal, x):
                    if (q := self.reach(rest, y)) is not None:
                        return form.format(p, q)
        return None


def solve(numbers: tuple[int, ...], target: int) -> str | None:
    """An expression of all numbers that reaches the target; None if there is none.

    Some operation stands on top, and one of its sides holds at most half of the
    numbers.  So each small subset's values are tried as that side, and the rest
    of the numbers is asked for the value that is then missing.  Subsets go by
    size and place, so results are reproducible.
    """
    return _Puzzle(numbers).reach((1 << len(numbers)) - 1, Fraction(target)) if numbers else None


@F.pandas_udf(T.StringType())
def _solve_batches(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    known = lru_cache(200_000)(solve)
    for numbers, target in batches:
        yield pd.Series([known(tuple(sorted(int(x) for x in n)), int(t)) if _whole(n, t) else None for n, t in zip(numbers, target, strict=True)], dtype=object)


def solve_puzzle(numbers: Column | str, target: Column | str) -> Column:
    """Solution of (numbers, target), null if there is none or the puzzle has nulls; a worker solves each sorted puzzle once."""
    return _solve_batches(numbers, F.col(target).cast("string") if isinstance(target, str) else target.cast("string"))
