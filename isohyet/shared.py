"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names, or else the context's checkpoint folder.

    Where neither is set, a session on one machine (tests) gets a temporary folder; on
    a cluster that is an error, as executors would write where nobody else reads.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="shared-"))
        base = context.getCheckpointDir()
    elif context.getCheckpointDir() is None:
        context.setCheckpointDir(base)
    return base.rstrip("/")


def shuffled(side: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: joined by its keys, and not sent whole through
    the driver where its estimated size is small."""
    return side.hint("merge")
