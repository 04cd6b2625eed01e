"""Steps whose results are kept: lineage cut in the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """The rows, written to the folder that ``spark.checkpoint.dir`` names; a plan that reads them starts anew.

    A temporary folder is made only where none is named and all runs on one machine.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="puzzlemill-checkpoint-"))
    return df.checkpoint()
