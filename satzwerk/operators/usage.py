"""Token usage and cost of correction calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from satzwerk.functions import text as tx

#: What a call may report; NULL where it does not.
USAGE_TYPE = "prompt_tokens bigint, completion_tokens bigint, total_tokens bigint, cost double"


def total_columns() -> list[Column]:
    """The sums of all usage columns; missing numbers count as zero."""

    def total(column: str, kind: str) -> Column:
        zero = F.lit(0).cast(kind)
        return F.coalesce(F.sum(F.coalesce(F.col(column), zero)), zero).alias(column)

    return [total(*field.split(" ")) for field in USAGE_TYPE.split(", ")]


def usage_totals(usage: DataFrame) -> DataFrame:
    """One row of sums over ``usage``; missing numbers count as zero."""
    return usage.agg(*total_columns())


def cost_info(usage: DataFrame) -> DataFrame:
    """The usage line as one row ``info``."""
    return usage_totals(usage).select(
        tx.cost_info(
            F.col("cost"), F.col("total_tokens"), F.col("prompt_tokens"), F.col("completion_tokens")
        ).alias("info")
    )
