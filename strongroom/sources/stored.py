"""Cutting a plan where several consumers would each run it again."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def stored(df: DataFrame) -> DataFrame:
    """The rows written once to the checkpoint folder and read from there.

    The folder is the one the session names in ``spark.checkpoint.dir``, which every executor reaches,
    so the rows outlive the executors that made them. A session that names none gets its own only where
    driver and executors are one process; on a cluster that is an error.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        alone = context.master == "local" or context.master.startswith("local[")
        if not named and not alone:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return df.checkpoint(eager=True)
