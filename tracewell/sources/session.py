"""Cutting the lineage of tables that are read more than once."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame, eager: bool = False) -> DataFrame:
    """The table without its plan, by a checkpoint in the folder that the session names in spark.checkpoint.dir.

    A folder of this machine is set only where the session names none and runs in one process; elsewhere that is an error.
    Unless it is eager, nothing runs before the table is read.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=eager)


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and written tables."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()
