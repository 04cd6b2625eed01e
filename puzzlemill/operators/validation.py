"""Checks of whole records: exact fields, free JSON, sources, chosen rows."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .checks import duplicate_ids
from .records import validated

#: Deepest nesting that records may have.
DEEPEST = 64
CHOSEN = ("id", "prompt", "response", "numbers", "target")


def schema_violations(found: T.StructType, wanted: T.StructType) -> list[str]:
    """What of a schema is missing, unknown or of another type, by path; order and nullability do not count."""

    def compare(a: T.DataType, b: T.DataType, path: str) -> Iterator[str]:
        if isinstance(a, T.StructType) and isinstance(b, T.StructType):
            have, want = {f.name: f.dataType for f in a}, {f.name: f.dataType for f in b}
            yield from (f"missing: {path}{n}" for n in want if n not in have)
            yield from (f"unknown: {path}{n}" for n in have if n not in want)
            for n in want.keys() & have.keys():
                yield from compare(have[n], want[n], f"{path}{n}.")
        elif isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
            yield from compare(a.elementType, b.elementType, f"{path.rstrip('.')}[].")
        elif a != b:
            yield f"type: {path.rstrip('.')} is {a.simpleString()}, not {b.simpleString()}"

    return sorted(compare(found, wanted, ""))


def depth(kind: T.DataType) -> int:
    """Nesting of a declared type; a plain column has none."""
    if isinstance(kind, T.StructType):
        return 1 + max((depth(f.dataType) for f in kind), default=0)
    if isinstance(kind, T.ArrayType):
        return 1 + depth(kind.elementType)
    if isinstance(kind, T.MapType):
        return 1 + max(depth(kind.keyType), depth(kind.valueType))
    return 0


def require_schema(df: DataFrame, wanted: str) -> DataFrame:
    """``df`` if it has exactly the declared fields, nested no deeper than allowed."""
    target = T.StructType.fromDDL(wanted)
    wrong = schema_violations(df.schema, target)
    if depth(df.schema) > DEEPEST + 1:
        wrong.append(f"nested deeper than {DEEPEST}")
    if wrong:
        raise ValueError("; ".join(wrong))
    return df.select(*target.names)


def _json_fault(text: str) -> str | None:
    """What keeps a text from being a plain JSON value; None if nothing does."""

    def refuse(name: str) -> None:
        raise ValueError(name)

    def number(digits: str) -> float:
        return value if math.isfinite(value := float(digits)) else refuse(digits)

    def object_(pairs: list[tuple[str, object]]) -> dict:
        out = dict(pairs)
        return out if len(out) == len(pairs) else refuse("a key twice")

    try:
        value = json.loads(text, parse_constant=refuse, parse_float=number, object_pairs_hook=object_)
    except RecursionError:
        return "nesting"
    except json.JSONDecodeError:
        return "json"
    except ValueError as e:
        return "key" if str(e) == "a key twice" else "non_finite"
    level, layer = 0, [value]
    while layer := [x for x in layer if isinstance(x, dict | list)]:
        if level > DEEPEST:
            return "nesting"
        level += 1
        layer = [y for x in layer for y in (x.values() if isinstance(x, dict) else x)]
    return None


@F.pandas_udf(T.StringType())
def json_fault(text: pd.Series) -> pd.Series:
    """json, key (one twice), non_finite or nesting; null for a plain JSON value, ``json`` for a null text."""
    return text.map(lambda x: _json_fault(x) if isinstance(x, str) else "json")


@F.pandas_udf(T.StringType())
def canonical_value(text: pd.Series) -> pd.Series:
    """A plain JSON value with sorted keys and without spaces; null for anything else."""

    def one(x: object) -> str | None:
        if not isinstance(x, str) or _json_fault(x) is not None:
            return None
        return json.dumps(json.loads(x), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)

    return text.map(one)


def exact_keys(text: Column, *keys: str) -> Column:
    """Does a JSON object have exactly these keys?"""
    found = F.json_object_keys(text)
    return F.coalesce(F.array_sort(found) == F.array_sort(F.array(*[F.lit(k) for k in keys])), F.lit(False))


def _violations(*rules: tuple[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules]))


def teacher_source_violations(rows: DataFrame) -> DataFrame:
    """Adds violations of rows that responses are asked for; ids that occur twice are found by one aggregation."""
    again = duplicate_ids(rows, "id").select(F.col("id").alias("_twice"), F.lit(True).alias("_again"))
    rows = rows.join(again, F.col("id").eqNullSafe(F.col("_twice")), "left")
    rules = [
        ("id", F.length(F.col("id").cast("string")) > 0),
        ("duplicate_id", F.col("_again").isNull()),
        ("prompt", F.length(F.btrim("prompt")) > 0),
        ("numbers", F.col("numbers").isNotNull() & ~F.exists("numbers", lambda x: x.isNull())),
        ("target", F.col("target").isNotNull()),
    ]
    return rows.withColumn("violations", _violations(*rules)).drop("_twice", "_again")


def chosen_violations(rows: DataFrame) -> DataFrame:
    """Adds violations of rows that may stand as chosen: all fields, and a response that solves the puzzle."""
    if missing := [c for c in CHOSEN if c not in rows.columns]:
        raise ValueError(f"chosen rows lack {', '.join(missing)}")
    checked = validated(rows.withColumnRenamed("validation", "_declared"))
    rules = [
        ("id", F.length(F.col("id").cast("string")) > 0),
        ("prompt", F.length(F.btrim("prompt")) > 0),
        ("response", F.length("response") > 0),
        ("numbers", F.size("numbers") > 0),
        ("correct", F.col("validation.ok")),
    ]
    out = checked.withColumn("violations", _violations(*rules)).drop("validation")
    return out.withColumnRenamed("_declared", "validation")


def count_violations(counts: dict[str, object]) -> list[str]:
    """Equations that stage counts must meet, of those that are there.

    All rows are solvable or unsolved, and a finished collection has as many
    accepted rows as its target.
    """
    wrong = [f"{k} is no whole number" for k, v in counts.items() if type(v) is not int or v < 0]
    if wrong:
        return sorted(wrong)
    if {"train_input", "solvable_train", "unsolved_train"} <= counts.keys() and counts["train_input"] != counts["solvable_train"] + counts["unsolved_train"]:
        wrong.append("train_input is not solvable_train + unsolved_train")
    if "target_accepted_count" in counts:
        if counts["target_accepted_count"] == 0:
            wrong.append("target_accepted_count is 0")
        if counts.get("accepted_count") != counts["target_accepted_count"]:
            wrong.append("accepted_count is not target_accepted_count")
    return wrong
