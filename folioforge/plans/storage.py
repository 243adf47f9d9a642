"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of ``df`` with their lineage cut: written as Parquet and read back.

    Unlike a checkpoint of rows, what reads them keeps column pruning, pushed filters and
    sizes. Uses the session's spark.checkpoint.dir; only where none is set and everything runs in
    one process on one machine, as in tests, a temporary folder is made.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="folioforge-"))
        base = context.getCheckpointDir()
    path = f"{base.rstrip('/')}/folioforge-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
