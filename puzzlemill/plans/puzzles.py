"""A deterministic puzzle view over the order lines, in Spark and in SQL.

Orders with three lines or more give a puzzle: the first 3 to 5 of their sorted
quantities, with target n1 + n2 * n3 + the rest.  The response follows one of
eight templates by order key; the SQL side knows each template's outcome from
the template and plain arithmetic, never by parsing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers as A

#: CTEs ``puzzles`` (k, id, numbers, target, gold, kind, response, expression, error, value) for the oracles.
SQL = """
q AS (SELECT l_orderkey AS k, list_sort(list(CAST(l_quantity AS BIGINT))) AS a FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 3),
b AS (SELECT k, k % 8 AS kind, a[1:least(len(a), 3 + k % 3)] AS n FROM q),
c AS (SELECT k, kind, n, n[1] + n[2] * n[3] + coalesce(list_sum(n[4:]), 0) AS target, list_sum(n) AS total,
  array_to_string(list_transform(n, lambda x: CAST(x AS VARCHAR)), '+') AS sum_text,
  array_to_string(list_concat(['(' || n[1] || '+(' || n[2] || '*' || n[3] || '))'], list_transform(n[4:], lambda x: CAST(x AS VARCHAR))), '+') AS gold,
  array_to_string(list_concat([n[1] || '+' || n[3] || '/(1/' || n[2] || ')'], list_transform(n[4:], lambda x: CAST(x AS VARCHAR))), '+') AS odd FROM b),
puzzles AS (SELECT k, 'train-' || lpad(CAST(k AS VARCHAR), CAST(greatest(6, length(CAST(k AS VARCHAR))) AS INTEGER), '0') AS id,
  CASE WHEN kind = 7 THEN list_concat(n, [CAST(1 AS BIGINT)]) ELSE n END AS numbers, CAST(target AS BIGINT) AS target, gold, kind,
  CASE kind WHEN 0 THEN '<answer> ' || gold || ' </answer>' WHEN 1 THEN '<answer>' || sum_text || '</answer>'
    WHEN 2 THEN 'So <ANSWER> ' || n[1] || '+' || n[2] || ' </ANSWER>' WHEN 3 THEN '<answer>' || n[1] || '**' || n[2] || '</answer>' WHEN 4 THEN gold
    WHEN 5 THEN '<answer> ' || gold || ' </answer> or <answer> (' || n[1]
    WHEN 6 THEN '<answer> ' || sum_text || ' </answer> no, <answer> ' || gold || ' </answer>' ELSE '<answer> ' || odd || ' </answer>' END AS response,
  CASE kind WHEN 0 THEN gold WHEN 1 THEN sum_text WHEN 2 THEN n[1] || '+' || n[2] WHEN 3 THEN n[1] || '**' || n[2] WHEN 6 THEN gold WHEN 7 THEN odd END AS expression,
  CASE kind WHEN 1 THEN CASE WHEN total <> target THEN 'wrong_value' END WHEN 2 THEN 'number_mismatch' WHEN 3 THEN 'invalid_expression'
    WHEN 4 THEN 'missing_answer_tag' WHEN 5 THEN 'missing_answer_tag' END AS error,
  CASE kind WHEN 1 THEN total || '/1' WHEN 2 THEN (n[1] + n[2]) || '/1' WHEN 0 THEN CAST(target AS BIGINT) || '/1' WHEN 6 THEN CAST(target AS BIGINT) || '/1' WHEN 7 THEN CAST(target AS BIGINT) || '/1' END AS value FROM c)
"""


def puzzles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, id, source_index, numbers, target, gold, kind, response)."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("k"), F.col("l_quantity").cast("bigint").alias("q"))
    rows = lines.groupBy("k").agg(F.sort_array(F.collect_list("q")).alias("a")).where(F.size("a") >= 3)  # a dozen lines at most
    n = F.slice("a", F.lit(1), F.least(F.size("a"), (3 + F.col("k") % 3).cast("int")))
    rows = rows.select("k", n.alias("n"), (F.col("k") % 8).alias("kind"))
    text = lambda i: F.get("n", F.lit(i)).cast("string")
    rest = F.transform(F.slice("n", F.lit(4), F.greatest(F.size("n") - 3, F.lit(0))), lambda x: x.cast("string"))

    def plus(first: Column) -> Column:
        return F.array_join(F.concat(F.array(first), rest), "+")

    gold = plus(F.concat(F.lit("("), text(0), F.lit("+("), text(1), F.lit("*"), text(2), F.lit("))")))
    odd = plus(F.concat(text(0), F.lit("+"), text(2), F.lit("/(1/"), text(1), F.lit(")")))
    total = F.array_join(F.transform("n", lambda x: x.cast("string")), "+")
    target = F.get("n", F.lit(0)) + F.get("n", F.lit(1)) * F.get("n", F.lit(2)) + F.aggregate(F.slice("n", F.lit(4), F.greatest(F.size("n") - 3, F.lit(0))), F.lit(0).cast("bigint"), lambda s, x: s + x)
    rows = rows.select("k", "n", "kind", gold.alias("gold"), odd.alias("odd"), total.alias("total"), target.alias("target"))
    one, two = text(0), text(1)
    wrap = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    kinds = [
        wrap("<answer> ", F.col("gold"), " </answer>"),
        wrap("<answer>", F.col("total"), "</answer>"),
        wrap("So <ANSWER> ", one, "+", two, " </ANSWER>"),
        wrap("<answer>", one, "**", two, "</answer>"),
        F.col("gold"),
        wrap("<answer> ", F.col("gold"), " </answer> or <answer> (", one),
        wrap("<answer> ", F.col("total"), " </answer> no, <answer> ", F.col("gold"), " </answer>"),
        wrap("<answer> ", F.col("odd"), " </answer>"),
    ]
    response = F.get(F.array(*kinds), F.col("kind").cast("int"))
    numbers = F.when(F.col("kind") == 7, F.concat("n", F.array(F.lit(1).cast("bigint")))).otherwise(F.col("n"))
    return rows.select("k", A.row_id("train", F.col("k")).alias("id"), F.col("k").alias("source_index"), numbers.alias("numbers"), "target", "gold", "kind", response.alias("response"))
