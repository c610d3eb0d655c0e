"""Cutting the lineage of iterated plans, and the folder for it."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where none is set, a local master gets one of its own and a cluster an error, as its machines share no temporary folder."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[.*\])?$", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="strandlake-"))
    return context.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """The table as a checkpoint in the shared folder, so that a lost executor doesn't cost the rounds before."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
