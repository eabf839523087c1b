"""Tables that are computed once and written to the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Where a local session without spark.checkpoint.dir writes.
LOCAL_FOLDER = "file:///tmp/checkpoints"
# Whether the shuffle files of a query go when it ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(folder or LOCAL_FOLDER).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(frame: DataFrame, name: str) -> DataFrame:
    """The rows from Parquet files, written now, after which the shuffle files of their query go.

    A stream, and columns of types that Parquet does not hold, are left as they are.
    """
    if frame.isStreaming or any(x in f.dataType.simpleString() for f in frame.schema for x in ("void", "interval")):
        return frame
    spark = frame.sparkSession
    path, before = scratch_path(spark, name), spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        frame.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEAN_UP)
        else:
            spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(frame.schema).parquet(path)
