"""Tables between the steps of a plan, in the shared folder that the session names."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local one where none is set, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        at = tempfile.mkdtemp(prefix="millrace-shared-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """df, computed once and read by all that builds on it; a lost executor costs a reread. Nothing stays in executors' memory."""
    at = shared_dir(df.sparkSession)
    if not df.sparkSession.sparkContext.getCheckpointDir():
        df.sparkSession.sparkContext.setCheckpointDir(at)
    return df.checkpoint()
