"""Evaluation as one flow: inputs checked, answers scored, metrics aggregated and published."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import answers as A
from ..sources.writers import extend_ledger, publish
from .checks import duplicate_ids, require_none
from .metrics import eval_summary
from .records import eval_samples


def evaluate(rows: DataFrame, respond: Callable[[DataFrame], DataFrame], cap: int) -> DataFrame:
    """Scored samples of rows (id, prompt, numbers, target).

    ``respond`` adds response, generated_tokens and finish_reason to every row;
    it may call any engine, in partitions or outside.  Every id must be there
    once, before and after.
    """
    require_none(duplicate_ids(rows, "id"), "an id is there twice")
    require_none(rows.where("id is null or prompt is null or length(trim(prompt)) = 0 or target is null or coalesce(size(numbers), 0) = 0"), "a row lacks id, prompt, numbers or target")
    told = respond(rows)
    samples = eval_samples(told.withColumn("truncated", A.is_truncated(F.col("finish_reason"), F.col("generated_tokens"), cap)))
    return samples.drop("finish_reason")


def publish_evaluation(samples: DataFrame, out: str, step: int, compat: str = "v2") -> dict:
    """Samples as a table, their metrics as a line of the ledger, which comes last."""
    samples = samples.persist()
    n = publish(samples, f"{out}/step_{step}/samples")
    row = json.loads(eval_summary(samples, compat=compat).select(F.to_json(F.struct("*")).alias("j")).first().j)
    samples.unpersist()
    if row["count"] != n:
        raise ValueError(f"{n} samples were written, {row['count']} were counted")
    extend_ledger(samples.sparkSession, f"{out}/ledger.jsonl", [{"step": step, "metrics": row, "samples": f"step_{step}/samples", "metrics_file": "ledger.jsonl"}])
    return row
