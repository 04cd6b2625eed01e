"""Structured Streaming forms: exactly-once accumulation and metric logs."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.records import validated
from ..operators.rollouts import cut_at_target
from ..sources.store import Store
from ..sources.writers import canonical_json

#: Number of the batch that holds rows of an older collection.
ADOPTED = -1


def accumulate(requests: DataFrame, respond: Callable[[DataFrame], DataFrame], out: str, target: int, checkpoint: str, contract: dict, position: str = "source_index", operational: tuple[str, ...] = ()) -> StreamingQuery:
    """Answer a stream of requests batch by batch until ``target`` rows are accepted, no more.

    Rows of the batch that completes the target count up to the one that does, by
    ``position``.  A batch writes accepted and rejected rows as one table and is
    committed by one marker, which also holds its counts; rows without marker do
    not exist.  A batch that runs again after a crash replaces its own output
    and nothing else.  A changed contract is refused, but for ``operational``
    fields; the stream's checkpoint remembers which requests are done.
    """
    spark = requests.sparkSession
    store = Store(spark)
    fixed = {k: v for k, v in contract.items() if k not in operational}
    if store.exists(f"{out}/contract.json") and json.loads(store.read(f"{out}/contract.json")) != json.loads(canonical_json(fixed)):
        raise ValueError("the contract differs from the one that the output was made under")
    store.write(f"{out}/contract.json", canonical_json(fixed) + "\n")

    def step(batch: DataFrame, number: int) -> None:
        have = sum(m["accepted"] for n, m in commits(batch.sparkSession, out).items() if n < number)
        if have < target:
            _commit(respond(batch), out, number, target - have, position)

    return requests.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _commit(rows: DataFrame, out: str, number: int, need: int, position: str) -> None:
    where = f"{out}/rows/batch={number}"
    rows = rows.persist()
    cut_at_target(rows, need, position).write.mode("overwrite").parquet(where)
    rows.unpersist()
    counts = {r.ok: r.n for r in rows.sparkSession.read.schema(rows.schema).parquet(where).groupBy("ok").agg(F.count("*").alias("n")).collect()}
    Store(rows.sparkSession).write(f"{out}/commits/{number}.json", canonical_json({"accepted": counts.get(True, 0), "rejected": counts.get(False, 0) + counts.get(None, 0)}) + "\n")


def commits(spark: SparkSession, out: str) -> dict[int, dict]:
    """Counts of the committed batches by number."""
    store = Store(spark)
    return {int(n.removesuffix(".json")): json.loads(store.read(f"{out}/commits/{n}")) for n in store.names(f"{out}/commits") if n.endswith(".json") and not n.startswith(".")}


def adopt(rows: DataFrame, out: str, target: int, position: str = "source_index") -> None:
    """Take over rows of an older collection: every one is validated again, what was declared does not count."""
    if commits(rows.sparkSession, out):
        raise ValueError("the output has batches already")
    again = validated(rows.drop("validation", "ok"))
    _commit(again.withColumn("ok", F.coalesce(F.col("validation.ok"), F.lit(False))), out, ADOPTED, target, position)


def accepted(spark: SparkSession, out: str, ok: bool = True) -> DataFrame:
    """What all committed batches have accepted (or rejected) so far."""
    done = sorted(commits(spark, out))
    if not done:
        return spark.createDataFrame([], "batch int")
    rows = spark.read.option("basePath", f"{out}/rows").parquet(*[f"{out}/rows/batch={n}" for n in done])
    return rows.where(F.col("ok") if ok else ~F.coalesce("ok", F.lit(False)))


def status(spark: SparkSession, out: str, target: int) -> str:
    """complete, or open if the target is not reached (yet, or since the requests are exhausted)."""
    return "complete" if sum(m["accepted"] for m in commits(spark, out).values()) >= target else "open"


def windowed_metrics(rollouts: DataFrame, time: str = "ts", delay: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Mean reward and count by time window of a stream of rollouts; late rows beyond the delay are dropped."""
    return rollouts.withWatermark(time, delay).groupBy(F.window(time, size)).agg(F.count("*").alias("n"), F.avg("reward").alias("reward"))
