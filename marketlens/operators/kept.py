"""Tables that are computed once: checkpoints in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; only where it is unset and the master is local, a temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="marketlens-kept-"))
    return sc.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """df, computed once, with its partitions and their order; lost executors don't undo it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
