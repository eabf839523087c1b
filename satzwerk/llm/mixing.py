"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a target of words. Whole epochs come first: a source with a
target of 1.4 times its size gives every document once. The rest is a weighted
sample without replacement: documents sorted by ``-ln(u) / w``, with ``u`` drawn
from the doc_id and ``w`` the weight of the document's quality, fill the budget
from the front. The last document is cut at the budget.

Only DataFrame functions run here. The sums along the order are taken in two
steps, over bins of the key and within a bin, so no task sorts a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from satzwerk.llm.shared import saved, word_count

#: Rows that a bin of the order holds on average.
BIN_ROWS = 4096
#: Weight of a document by its quality label: good, bad, not labelled.
GOOD, BAD, UNKNOWN = 2.0, 0.5, 1.0


def uniform(key: Column) -> Column:
    """A number strictly between 0 and 1 that the key alone decides."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(16**12)


def quality_weight(quality: Column) -> Column:
    return F.when(quality == 1, GOOD).when(quality == 0, BAD).otherwise(UNKNOWN)


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """The target of each source; input and output have one row per source.

    Sources in code point order, NULL last, take the weights in turn. They share
    ``share`` times all words by weight, no source above ``most`` times its own;
    what is cut off is shared by weight among the others. With the sources in
    order of the level at which they are full, the first k are cut for the
    smallest k whose common level no further source overflows.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), place + 1)
    rows = sizes.withColumn("_weight", weight.cast("bigint")).withColumn(
        "_full", F.col("source_size") * most
    )
    by_level = Window.orderBy(F.col("_full") / F.col("_weight"), F.col("source").asc_nulls_last())
    ahead = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (
        F.sum("source_size").over(everything) * share - F.coalesce(F.sum("_full").over(ahead), F.lit(0.0))
    ) / F.sum("_weight").over(onward)
    rows = rows.withColumn("_level", level).withColumn("_rank", F.row_number().over(by_level))
    overflows = F.col("_level") > F.col("_full") / F.col("_weight")
    first = F.struct(overflows, F.col("_rank"))
    return rows.withColumn("_common", F.min_by("_level", first).over(everything)).select(
        "source",
        "source_size",
        "source_rows",
        F.least(F.col("_common") * F.col("_weight"), F.col("_full")).alias("target"),
    )


def mix(
    docs: DataFrame,
    labels: DataFrame | None = None,
    carry: tuple[str, ...] = (),
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
) -> DataFrame:
    """Words taken of each document: doc_id, size, source_size, target, taken, _doc.

    ``labels`` (doc_id, quality) give the weights; without them all are equal. The
    columns named in ``carry`` come along in the struct ``_doc``, whatever they
    are called. Every row is mixed on its own: equal rows have equal keys and
    stand next to each other in the order. A NULL or empty text has size 0 and
    gives 0 words, a NULL source is a source, a NULL doc_id has a key. An empty
    table gives an empty one.
    """
    rows = docs.select(
        "doc_id",
        "source",
        word_count(F.col("text")).alias("size"),
        F.struct(*carry or [F.lit(1).alias("_")]).alias("_doc"),
    )
    if labels is None:
        rows = rows.withColumn("_w", F.lit(UNKNOWN))
    else:
        marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("_q"))
        rows = rows.join(marks, "doc_id", "left").withColumn("_w", quality_weight(F.col("_q"))).drop("_q")
    rows = saved(rows.withColumn("_key", -F.log(uniform(F.col("doc_id"))) / F.col("_w")), "mix")

    sizes = rows.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count("*").alias("source_rows")
    )
    targets = source_targets(sizes, weights, share, most).withColumnRenamed("source", "_source")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
    rows = (
        rows.join(targets, F.col("source").eqNullSafe(F.col("_source")))
        .drop("_source")
        .withColumn("epochs", F.coalesce(epochs, F.lit(0)).cast("bigint"))
        .withColumn("_rest", F.floor(F.col("target") - F.col("epochs") * F.col("source_size") + 0.5))
        .withColumn("_bins", F.floor(F.col("source_rows") / BIN_ROWS) + 1)
        .withColumn("_bin", F.floor(F.col("_bins") * (1 - F.exp(-F.col("_key")))))
    )
    by_bin = Window.partitionBy("source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = (
        rows.groupBy("source", "_bin")
        .agg(F.sum("size").alias("_size"))
        .select(
            F.col("source").alias("_source"),
            F.col("_bin").alias("_at"),
            F.coalesce(F.sum("_size").over(by_bin), F.lit(0)).alias("_before"),
        )
    )
    within = (
        Window.partitionBy("source", "_bin")
        .orderBy("_key", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    place = F.coalesce(F.sum("size").over(within), F.lit(0)) + F.col("_before")
    part = F.least(F.greatest(F.col("_rest") - place, F.lit(0)), F.col("size"))
    return rows.join(
        bins, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_bin") == F.col("_at"))
    ).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("epochs") * F.col("size") + part).cast("bigint").alias("taken"),
        "_doc",
    )


def expand(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix as documents: a row for each time a document is taken.

    A document of which a part is taken is given whole, so no text is cut here.
    """
    copies = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(0)
    times = F.when(copies > 0, F.sequence(F.lit(1), copies.cast("int"))).otherwise(F.array().cast("array<int>"))
    return mixed.withColumn("_copy", F.explode(times)).select(*(F.col("_doc")[c].alias(c) for c in columns))
