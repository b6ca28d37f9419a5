"""Tables of a directory, session settings and durable intermediate results."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table of that name (a file or a folder)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """Number of tasks of a spread stage: the session's shuffle partitions, at least the cores it has."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt evenly to all cores ahead of costly Python work; files alone may give too few tasks. Always by all of the
    row's columns or by the keys, never round robin, so that a task that runs again after a lost executor gets the same rows.
    Where the files give enough tasks already, nothing is shuffled."""
    if not keys and df.rdd.getNumPartitions() >= partitions(df.sparkSession):
        return df
    return df.repartition(partitions(df.sparkSession), *(keys or (F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]),)))


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. A folder of this machine is taken only in local mode where
    the session names none, as in tests; a cluster must name one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="factloom-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder; survives lost executors and cuts the lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
