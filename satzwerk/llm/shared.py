"""What several operators need: the shared folder, saved tables, words."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Where a local session without ``spark.checkpoint.dir`` keeps its tables.
LOCAL_FOLDER = "file:///tmp/checkpoints"
#: Rows whose texts a Python worker holds as objects at once.
ROWS = 512
#: Whether the shuffle files of a query go when it ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return LOCAL_FOLDER


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def cleaned_up(spark: SparkSession) -> Iterator[None]:
    """Queries that are run once leave no shuffle files."""
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEAN_UP)
        else:
            spark.conf.set(CLEAN_UP, before)


def saved(frame: DataFrame, name: str) -> DataFrame:
    """Write ``frame`` to the shared folder as Parquet and go on from there.

    The files outlive any executor, so what follows never repeats what came before,
    and shuffle files on the way go as soon as all is written.
    """
    spark = frame.sparkSession
    path = new_path(spark, name)
    with cleaned_up(spark):
        frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def forget(frame: DataFrame) -> None:
    """Delete the files of a saved table that nothing reads any more."""
    spark = frame.sparkSession
    files = frame.inputFiles()
    if not files:
        return
    folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def word_count(text: Column) -> Column:
    """How many words a text has; NULL has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def portions(batch: pa.RecordBatch | pa.Array) -> Iterator:
    """The rows of a batch, ``ROWS`` at a time, so that few of its texts are objects at once."""
    for at in range(0, len(batch), ROWS):
        yield batch.slice(at, ROWS)


def per_text(docs: DataFrame, start: Callable[[], Callable[[str | None], tuple]], fields: str) -> DataFrame:
    """Per row its doc_id and what a function makes of its text.

    ``start`` is called once in each task and returns the function; ``fields``
    names and types what that returns. Arrow batches keep ids exact even where
    some are NULL.
    """
    schema = StructType([docs.schema["doc_id"], *StructType.fromDDL(fields).fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in chain.from_iterable(map(portions, batches)):
            rows = [work(text) for text in batch.column(1).to_pylist()]
            columns = zip(*rows)
            arrays = [pa.array(column, field.type) for column, field in zip(columns, list(arrow)[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow[0].type), *arrays], schema=arrow)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
