"""Cutting lineage in the shared checkpoint folder, and spreading small inputs over the cores."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def checkpoint_dir(spark) -> str:
    """The cluster's shared folder; where none is set a temporary one becomes the setting, under a local master only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if sc.master.split("[")[0] != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="lexmill-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: survives the loss of executors, and later plans start from its files."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bytes of stored input for one partition of rows whose words are worked on.
PART_BYTES = 16 << 20


def parts(df: DataFrame) -> int:
    """Partitions for shuffled rows of df: their number grows with the files read, so that none of them does.

    Inputs that are no files (their size is unknown) get the session's number of shuffle partitions.
    """
    spark = df.sparkSession
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    if size >= 1 << 60:
        return int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(spark.sparkContext.defaultParallelism, -(-size // PART_BYTES))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal a table of too few splits over the cores; a table that already has splits enough is left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() * 2 > cores else df.repartition(cores, *keys)
