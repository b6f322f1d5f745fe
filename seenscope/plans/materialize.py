"""Write an intermediate table to the cluster's shared folder and read it back.

A written table cuts lineage, survives the loss of an executor, is read column by
column, and has a size that Catalyst knows. So a tiny table (one row per dataset) is
broadcast only if its files are below ``spark.sql.autoBroadcastJoinThreshold``, and
joined by shuffle if not.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach: the session's checkpoint directory.

    One is chosen here only if none is set and the whole session is one process.
    """
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if folder:
        return folder
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="seenscope-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, one subfolder per application."""
    app = spark.sparkContext.applicationId
    return f"{shared_folder(spark).rstrip('/')}/seenscope-{app}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet and return the written table."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
