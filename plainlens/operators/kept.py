"""Tables that several later steps read, worked out once."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share. Only a local session may go without; it gets a folder of its own."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="plainlens-"))
    return context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """The rows as a checkpoint in the shared folder, so a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
