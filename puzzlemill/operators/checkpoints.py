"""Choice, matching and retention of training checkpoints; evaluation matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.answers import checkpoint_number
from .checks import require


def best_checkpoint(ledger: DataFrame, *by: str) -> DataFrame:
    """Highest accuracy, then format rate, then the earliest step; by run if named."""
    best = F.max_by(F.struct("step", "accuracy", "format_rate"), F.struct("accuracy", "format_rate", -F.col("step"))).alias("best")
    return (ledger.groupBy(*by) if by else ledger.groupBy()).agg(best, F.max("step").alias("final_step")).select(*by, "best.step", "best.accuracy", "best.format_rate", "final_step")


def latest_checkpoint(names: DataFrame, column: str = "name", *by: str) -> DataFrame:
    """The name with the largest trailing number; by run if named."""
    best = F.max_by(column, F.struct(checkpoint_number(F.col(column)), F.col(column))).alias(column)
    return names.groupBy(*by).agg(best) if by else names.agg(best)


def match_steps(dumps: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Steps that have a metrics dump and a checkpoint; one without the other fails."""
    a = dumps.withColumn("_a", F.lit(True))
    b = checkpoints.withColumn("_b", F.lit(True))
    both = a.join(b, "step", "full_outer")
    both = require(both, F.col("_a").isNotNull(), "a checkpoint without metrics")
    return require(both, F.col("_b").isNotNull(), "metrics without a checkpoint").drop("_a", "_b")


def retained(ledger: DataFrame, latest: int = 2) -> DataFrame:
    """Steps to keep: the latest ones and the best."""
    last = ledger.select("step").distinct().orderBy(F.desc("step")).limit(latest)
    return last.unionByName(best_checkpoint(ledger).select("step")).distinct()


def due_evaluations(steps: DataFrame, every: int, last: int) -> DataFrame:
    return steps.where((F.col("step") % every == 0) | (F.col("step") == last))


def evaluation_matrix(models: DataFrame, datasets: DataFrame, results: DataFrame) -> DataFrame:
    """A cell for each model and data set; cells without a result are marked as failed.

    Models and data sets are short lists, so their product is too.
    """
    cells = models.select("model").distinct().withColumn("dataset", F.explode(F.lit([r.dataset for r in datasets.select("dataset").distinct().orderBy("dataset").collect()])))
    return cells.join(results, ["model", "dataset"], "left").withColumn("status", F.when(F.col("accuracy").isNull(), "failed").otherwise("complete"))


def running_best(ledger: DataFrame, run: str) -> DataFrame:
    """Best accuracy so far at each step of a run."""
    w = W.partitionBy(run).orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    return ledger.withColumn("best_accuracy", F.max("accuracy").over(w))
