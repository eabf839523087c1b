import pyarrow as pa
from pyspark.sql import functions as F

from satzwerk.llm import shared


def shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}


def test_saved_tables_leave_no_shuffle_files(spark):
    before, setting = shuffle_files(spark), spark.conf.get(shared.CLEAN_UP)
    frame = spark.range(20_000).withColumn("x", F.md5(F.col("id").cast("string"))).repartition(4, "x")
    kept = shared.saved(frame, "test-saved")
    assert shuffle_files(spark) <= before
    assert kept.count() == 20_000 and spark.conf.get(shared.CLEAN_UP) == setting
    # The same frame can be saved and read again.
    assert shared.saved(frame, "test-saved").agg(F.sum("id")).first()[0] == frame.agg(F.sum("id")).first()[0]


def test_batches_are_taken_apart(spark):
    batch = pa.RecordBatch.from_pydict({"n": range(1500)})
    sizes = [part.num_rows for part in shared.portions(batch)]
    assert sum(sizes) == 1500 and max(sizes) <= 512
    assert [len(part) for part in shared.portions(batch.column(0))] == sizes
    assert list(shared.portions(batch.slice(0, 0))) == []
    # Only the texts of one portion are objects at once.
    docs = spark.range(1500).selectExpr("id AS doc_id", "CAST(id AS string) AS text").coalesce(1)
    found = shared.per_text(docs, lambda: lambda text: (int(text) + 1,), "n bigint").collect()
    assert [tuple(row) for row in found] == [(i, i + 1) for i in range(1500)]
