"""The same metrics over text files as they arrive.

The plans hold no aggregate and no join when their tables fit inline, so they
need neither state nor a watermark on a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from satzwerk.functions import text as tx
from satzwerk.sources.texts import plain_address


def read_text_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Each new file in ``folder`` is one text: filename, text."""
    files = spark.readStream.text(folder, wholetext=True)
    return files.select(
        plain_address(F.col("_metadata.file_name")).alias("filename"),
        tx.universal_newlines(F.col("value")).alias("text"),
    )


def write_available(frame: DataFrame, path: str, progress: str) -> StreamingQuery:
    """Append what has arrived since the last run to a parquet table, then stop."""
    return (
        frame.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )
