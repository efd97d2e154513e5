"""Cutting lineage in the folder that the executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where it is unset, a new temporary folder if driver and executors are one
    process; on a cluster that is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir")
        if shared is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            shared = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(shared)
    return context.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """``df.checkpoint()`` in ``folder``."""
    folder(df.sparkSession)
    return df.checkpoint()
