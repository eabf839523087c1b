"""Sinks. Each writes part files in order; none passes its data through one task.

A part file of a small result is the whole result, since adaptive execution
merges small partitions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from satzwerk.functions import fixed, text as tx
from satzwerk.operators.correction import TextCorrector, correct_whole_text

# Quotes are doubled and white space at the ends of a field is kept.
CSV_FORMAT = {
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def metrics_rows(metrics: DataFrame, name: str = "name") -> DataFrame:
    """The columns of the metrics CSV under their printed names."""
    return metrics.select(
        F.col(name).alias("Text"),
        *(F.col(column).alias(label) for label, column in fixed.METRIC_SERIES.items()),
    )


def write_metrics_csv(
    metrics: DataFrame, path: str, order_by: str = "text_id", name: str = "name"
) -> bool:
    """Write one CSV row per text, in text order. Needs two texts or more.

    Returns whether anything was written.
    """
    labels = (F.col(column).alias(label) for label, column in fixed.METRIC_SERIES.items())
    rows = metrics.select(F.col(order_by).alias("_order"), F.col(name).alias("Text"), *labels)
    rows = rows.persist(StorageLevel.DISK_ONLY)
    try:
        if len(rows.select("Text").take(2)) < 2:
            return False
        # Sorting samples its input first; the rows themselves are made once.
        rows.orderBy("_order").drop("_order").write.csv(path, header=True, lineSep="\r\n", **CSV_FORMAT)
    finally:
        rows.unpersist()
    return True


def write_corrected(
    texts: DataFrame,
    make_corrector: Callable[[], TextCorrector],
    path: str,
    text: str = "text",
    on_error: str = "raise",
) -> None:
    """Clean, correct and save the texts with a column ``llm_corrected_text``."""
    cleaned = texts.withColumn("_clean", tx.clean_text(F.col(text)))
    corrected = correct_whole_text(
        cleaned, make_corrector, "_clean", "llm_corrected_text", on_error
    )
    corrected.select(*texts.columns, "llm_corrected_text").write.csv(
        path, header=True, **CSV_FORMAT
    )


def report_lines(fragments: DataFrame) -> DataFrame:
    """The report as rows (row_idx, fragment): header, one section per text, footer."""
    spark = fragments.sparkSession
    ends = spark.createDataFrame(
        [(-1, fixed.REPORT_HEADER), (2**63 - 1, fixed.REPORT_FOOTER)],
        "row_idx bigint, fragment string",
    )
    return fragments.select("row_idx", "fragment").unionByName(ends)


def write_report(fragments: DataFrame, path: str) -> None:
    """Write the report; its part files, joined in name order, are the page."""
    report_lines(fragments).orderBy("row_idx").select("fragment").write.text(path)
