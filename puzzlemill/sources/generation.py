"""Engines behind a function: requests in partitions, with deadlines and bounded batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late

import pandas as pd
from pyspark.sql import DataFrame

Engine = Callable[[list[str]], list[dict]]
RESULT = "position bigint, text string, finish_reason string, token_count bigint"


def generate(requests: DataFrame, make_engine: Callable[[], Engine], batch_size: int, seconds: float) -> DataFrame:
    """(position, text, finish_reason, token_count) for requests (position, prompt).

    Each partition makes an engine of its own and asks it in batches.  An engine
    that is late, dies or answers another number of prompts fails its task,
    which Spark runs again elsewhere, a limited number of times.
    """

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine, pool = make_engine(), ThreadPoolExecutor(1)
        for frame in frames:
            for at in range(0, len(frame), batch_size):
                part = frame.iloc[at : at + batch_size]
                try:
                    told = pool.submit(engine, part["prompt"].tolist()).result(timeout=seconds)
                except Late:
                    pool.shutdown(wait=False, cancel_futures=True)
                    raise RuntimeError(f"no answer within {seconds} s") from None
                if len(told) != len(part):
                    raise RuntimeError(f"{len(told)} answers to {len(part)} prompts")
                out = pd.DataFrame(told, columns=["text", "finish_reason", "token_count"])
                out.insert(0, "position", part["position"].to_numpy())
                yield out
        pool.shutdown()

    return requests.select("position", "prompt").mapInPandas(rows, RESULT)
