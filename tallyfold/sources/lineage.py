"""Writing an intermediate table once so that several branches of a query can start from it."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir.

    Where that is unset a folder of our own is made, on one machine only: a cluster needs one that its hosts share.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tallyfold-checkpoint-")
        sc.setCheckpointDir(found)
    return found


def written(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def fanned(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys over twice as many tasks as there are cores, for grouped maps that compute much on few bytes.

    Adaptive execution joins partitions by their bytes and would give all such groups to one task.
    """
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, *keys)
