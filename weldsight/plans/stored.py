"""Frames that several steps read, kept in the shared folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of this machine only where none is named, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or os.path.join(tempfile.gettempdir(), "weldsight-checkpoints"))
    return sc.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: computed once, and read again when executors are lost."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
