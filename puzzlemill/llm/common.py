"""Helpers shared by the corpus operators: safe projections, checkpoints, words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: ASCII white space as the query contracts define it.
SPACE = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pick(df: DataFrame, **types: str) -> DataFrame:
    """Only the named columns, cast; a column that is missing is null.

    Whatever else the input carries (also names that clash with an operator's
    own columns) is dropped here, at the scan.
    """
    have = set(df.columns)
    return df.select(*[(F.col(f"`{c}`") if c in have else F.lit(None)).cast(t).alias(c) for c, t in types.items()])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    A plain column reference may be inlined by the optimizer into the body of a
    higher-order function and then run once per element; a lambda variable is
    a value and cannot be.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def words(text: Column) -> Column:
    """The maximal runs of non-space characters; null and blank text: no words."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return let(trimmed, lambda t: F.when(F.length(t) == 0, F.array().cast("array<string>")).otherwise(F.split(t, SPACE_RUN)))


def unit(*cols: Column) -> Column:
    """A reproducible number in [0, 1) drawn from the given values."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(1 << 53))


#: Bytes of an id in a broadcast table, and how many of all may be broadcast; more are joined by a shuffle.
ID_BYTES, MOST_BYTES = 64, 32 << 20


def small(ids: DataFrame) -> bool:
    """Whether a table of ids may be broadcast."""
    return ids.count() * ID_BYTES <= MOST_BYTES


def number_equal(rows: DataFrame, *keys: str) -> DataFrame:
    """Adds ``copy``: 1, 2, ... for rows of equal keys, 1 for all others, which are not moved.

    The others columns of ``rows`` must be in a struct ``row``, which orders equal ones.
    """
    twice = rows.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1").select(*keys, F.lit(True).alias("again"))
    if twice.isEmpty():
        return rows.withColumn("copy", F.lit(1))
    rows = rows.join(F.broadcast(twice) if small(twice) else twice, list(keys), "left")
    again = rows.where("again").withColumn("copy", F.row_number().over(W.partitionBy(*keys).orderBy(F.to_json("row"))))
    return rows.where("again is null").withColumn("copy", F.lit(1)).unionByName(again).drop("again")


#: Shuffle files of a step that has been written are of no more use.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _folder(spark: SparkSession) -> str:
    """The shared checkpoint folder, which the cluster names in ``spark.checkpoint.dir``.

    A temporary one is made only where that is unset and all runs on one machine.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="puzzlemill-checkpoint-"))
    return sc.getCheckpointDir()


@contextmanager
def _freeing_shuffles(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with files in the shared checkpoint folder; the step's shuffle files go."""
    _folder(df.sparkSession)
    with _freeing_shuffles(df.sparkSession):
        return df.checkpoint()


class Written(NamedTuple):
    """A table in the shared folder, and how to delete it after its last reader."""

    rows: DataFrame
    drop: Callable[[], None]


def written(df: DataFrame, plain: bool = False) -> Written:
    """Cut the lineage with a compressed table in the shared checkpoint folder.

    ``plain``: without dictionaries, which columns of hashes do not profit from.
    """
    spark = df.sparkSession
    where = f"{_folder(spark)}/{uuid.uuid4()}"
    with _freeing_shuffles(spark):
        df.write.option("parquet.enable.dictionary", str(not plain).lower()).parquet(where)

    def drop() -> None:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    return Written(spark.read.schema(df.schema).parquet(where), drop)
