"""Columns that are computed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def settled(frame: DataFrame, **columns: Column) -> DataFrame:
    """Add columns and make the plan compute each of them once per row.

    A plain projection is merged with what follows, and a filter on anything made
    of the column is pushed below it, which repeats a costly expression wherever
    it is used, even inside lambdas. Nothing is merged with, or pushed below, this
    one-row generator. It adds no shuffle.
    """
    kept = [F.col(f"`{name}`") for name in frame.columns if name not in columns]
    made = F.struct(*(column.alias(name) for name, column in columns.items()))
    return frame.select(*kept, F.inline(F.array(made)))
