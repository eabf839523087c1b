"""Answers of a correction backend that outlive a run.

A store is a folder of Parquet files with one answer per request. A run calls the
backend only for requests that the store does not hold, and appends what it gets.
Each task moves its file into the folder when it ends (the second algorithm of the
file committer), so what a run has answered before it was killed is kept, and a
file is there whole or not at all.

What a call reports of its usage (``correction.Answered``) is kept with the answer.
The totals of a run are observed in the job that calls; a task that is repeated
counts once there, as its file is there once.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from satzwerk.operators.correction import Corrector, correct_with, distinct_requests, with_answers
from satzwerk.operators.usage import USAGE_TYPE, total_columns

STORE_TYPE = f"key string, tokens array<string>, answer array<string>, error string, {USAGE_TYPE}"
#: Requests in one task: no more calls are lost with a task that is killed.
TASK_REQUESTS = 10_000


class CallTotals(NamedTuple):
    """What the calls of a run were, and what they reported; what they do not report is zero."""

    calls: int = 0
    failed: int = 0
    prompt_tokens: int = 0
    completion_tokens: int = 0
    total_tokens: int = 0
    cost: float = 0.0


def _is_there(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def _stored(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a store; one that is not there, or written before usage was kept, has NULLs or no rows."""
    if not _is_there(spark, path):
        return spark.createDataFrame([], STORE_TYPE)
    return spark.read.schema(STORE_TYPE).parquet(path)


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """key, answer and error of every request in the store; a store that is not there is empty.

    Two runs at a time may both have answered a request; then one answer counts, the
    same at every reading, and an answer before an error.
    """
    first = F.min(F.struct(F.col("error").isNotNull().alias("failed"), "answer", "error")).alias("_first")
    return _stored(spark, path).groupBy("key").agg(first).select("key", "_first.answer", "_first.error")


def read_usage(spark: SparkSession, path: str) -> DataFrame:
    """key and usage of every call in the store, for ``usage_totals`` and ``cost_info``.

    Two calls for one request, such as of two runs at a time or after an error, were
    both made and are two rows.
    """
    return _stored(spark, path).drop("tokens", "answer", "error")


def _known_keys(spark: SparkSession, path: str, retry: bool) -> DataFrame | None:
    """The keys that need no call; None if the store is not there."""
    if not _is_there(spark, path):
        return None
    stored = _stored(spark, path)
    return (stored.where("error IS NULL") if retry else stored).select("key").distinct()


def open_requests(frame: DataFrame, path: str, tokens: str = "tokens", retry: bool = True) -> DataFrame:
    """The distinct requests of ``frame`` without an answer in the store: key, tokens, n_texts.

    With ``retry`` a request whose call failed is open again.
    """
    known = read_answers(frame.sparkSession, path)
    known = known.where("error IS NULL") if retry else known
    return distinct_requests(frame, tokens).join(known.select("key"), "key", "left_anti")


def answer_open_requests(
    frame: DataFrame,
    make_corrector: Callable[[], Corrector],
    path: str,
    tokens: str = "tokens",
    on_error: str = "column",
    retry: bool = True,
) -> int:
    """Call the backend for every open request and append the answers; how many calls were made.

    This runs two jobs: one counts, one calls. A failed call is kept with its error.
    """
    return call_open_requests(frame, make_corrector, path, tokens, on_error, retry).calls


def call_open_requests(
    frame: DataFrame,
    make_corrector: Callable[[], Corrector],
    path: str,
    tokens: str = "tokens",
    on_error: str = "column",
    retry: bool = True,
) -> CallTotals:
    """``answer_open_requests`` with the totals of the calls of this run."""
    known = _known_keys(frame.sparkSession, path, retry)
    # As JSON a list takes less than half the bytes in an exchange, and it is what the key is made of.
    lists = frame.where(F.col(tokens).isNotNull()).select(F.to_json(tokens).alias("json"))
    keys = lists.select(F.sha2("json", 256).alias("key")).distinct()
    n = (keys if known is None else keys.join(known, "key", "left_anti")).count()
    if not n:
        return CallTotals()
    asked = lists.distinct().select(F.sha2("json", 256).alias("key"), "json")
    asked = asked if known is None else asked.join(known, "key", "left_anti")
    spread = asked.repartition(-(-n // TASK_REQUESTS), "key")
    spread = spread.select("key", F.from_json("json", "array<string>").alias("tokens"))
    answered = correct_with(spread, make_corrector, "tokens", "answer", on_error, with_usage=True)
    seen = Observation()
    answered = answered.observe(seen, F.count("*").alias("calls"), F.count("error").alias("failed"), *total_columns())
    answered.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(path)
    return CallTotals(**seen.get)


def correct_stored(
    frame: DataFrame,
    make_corrector: Callable[[], Corrector],
    path: str,
    tokens: str = "tokens",
    out: str = "corrected_tokens",
    id_col: str = "text_id",
    on_error: str = "column",
    retry: bool = True,
) -> DataFrame:
    """The corrected tokens and errors of all rows, by answers of this run or earlier ones.

    A NULL token list has no request and stays NULL. Equal lists share one answer.
    """
    answer_open_requests(frame, make_corrector, path, tokens, on_error, retry)
    answers = read_answers(frame.sparkSession, path).withColumnRenamed("answer", out)
    return with_answers(frame, answers, tokens, id_col)
