"""Intermediate tables, written to the shared folder of the cluster.

A staged table cuts lineage like ``checkpoint()`` does, survives lost executors, and unlike a checkpoint
it is columnar: every later pass reads only the columns it needs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class StagingFolderError(RuntimeError):
    """The session names no shared folder for intermediate tables."""


def staging_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session: a folder that the driver and all executors share. It must be
    set when the session is built; a folder of the driver's own would be invisible to the executors."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise StagingFolderError(
            "set spark.checkpoint.dir to a folder shared by the driver and all executors when building the session")
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{staging_folder(spark)}/tablewise/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and go on from the written table."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
