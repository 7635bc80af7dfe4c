"""Cutting lineage before a result is used by several later jobs."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables, which driver and executors share.

    It is the one the session names in ``spark.checkpoint.dir``.  Where that is unset, a local session (tests)
    gets a folder of its own; a cluster raises, as no folder of one machine would do.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if context.master.split("[")[0] != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="hostwatch-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` to the shared folder (see :func:`shared_folder`)."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
