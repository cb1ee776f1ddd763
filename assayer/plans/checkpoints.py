"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import re
from tempfile import mkdtemp

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session. A local session without one gets a temporary folder; a cluster has to name one."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not re.match(r"local(\[|$)", context.master):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    context.setCheckpointDir(mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder, so that lost executors cost no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
