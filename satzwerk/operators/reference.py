"""Reference tables (lexicon, rewrites) and the lookup of whole token arrays.

A lookup runs in one of three ways, chosen by the *measured* size of the table:

inline     little: a literal inside the expression; no join, no shuffle
broadcast  fits in executor memory: the distinct tokens of blocks are hash-joined
shuffled   larger: distinct tokens of blocks and table meet by key

The corpus is never broadcast. A reference table does not grow with it.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


# The literal travels with every task.
INLINE_BYTES = 1024 * 1024
BROADCAST_BYTES = 128 * 1024 * 1024
# Rows that share their distinct tokens in a join; a block of a 6 GB corpus has 6 MB of text.
BLOCKS = 1024


@dataclass(frozen=True)
class ReferenceTable:
    """Unique STRING ``key`` -> ``value`` of the DDL type ``value_type``."""

    value_type: str
    how: str
    rows: Mapping[str, Any] | None = None
    frame: DataFrame | None = None

    @staticmethod
    def from_rows(rows: Mapping[str, Any], value_type: str) -> ReferenceTable:
        """A table the driver already holds, such as the seed lexicon.

        Beyond ``INLINE_BYTES`` it becomes a DataFrame of the active session.
        """
        if len(json.dumps(dict(rows), ensure_ascii=False).encode()) > INLINE_BYTES:
            frame = reference_frame(SparkSession.active(), rows, value_type)
            return ReferenceTable.from_frame(frame)
        return ReferenceTable(value_type, "inline", rows=dict(rows))

    @staticmethod
    def from_frame(
        frame: DataFrame,
        inline_bytes: int = INLINE_BYTES,
        broadcast_bytes: int = BROADCAST_BYTES,
    ) -> ReferenceTable:
        """Measure ``frame(key, value)`` with one job and choose the way to look it up."""
        frame = frame.select("key", "value")
        size = frame.agg(table_bytes()).first()[0]
        return ReferenceTable.of_size(frame, size, inline_bytes, broadcast_bytes)

    @staticmethod
    def of_size(
        frame: DataFrame,
        size: int,
        inline_bytes: int = INLINE_BYTES,
        broadcast_bytes: int = BROADCAST_BYTES,
    ) -> ReferenceTable:
        """A table whose size, by ``table_bytes``, is known."""
        value_type = frame.schema["value"].dataType.simpleString()
        if size <= inline_bytes:
            pairs = frame.select("key", F.to_json(F.struct("value")).alias("json")).collect()
            rows = {pair.key: json.loads(pair.json).get("value") for pair in pairs}
            return ReferenceTable(value_type, "inline", rows=rows)
        how = "broadcast" if size <= broadcast_bytes else "shuffled"
        return ReferenceTable(value_type, how, frame=frame)

    def subset(self, keys: Iterable[str]) -> dict[str, Any]:
        """The values of a few given keys, on the driver."""
        keys = sorted(set(keys))
        if self.rows is not None:
            return {key: self.rows[key] for key in keys if key in self.rows}
        found = self.frame.where(F.col("key").isin(keys))
        pairs = found.select("key", F.to_json(F.struct("value")).alias("json")).collect()
        return {pair.key: json.loads(pair.json).get("value") for pair in pairs}


def table_bytes() -> Column:
    """The bytes of keys and values, as an aggregate."""
    value = F.coalesce(F.octet_length(F.to_json(F.struct("value"))), F.lit(0))
    return F.coalesce(F.sum(F.octet_length("key") + value), F.lit(0))


def inline_value(key: Column, rows: Mapping[str, Any], value_type: str) -> Column:
    """The value of ``key`` in a small literal table, else NULL.

    Set membership is a hash probe, so the linear map search is left to hits.
    """
    if not rows:
        return F.lit(None).cast(value_type)
    table = F.from_json(
        F.lit(json.dumps(dict(rows), ensure_ascii=False)), f"map<string,{value_type}>"
    )
    return F.when(key.isin(*rows), F.try_element_at(table, key))


def lookup_tokens(frame: DataFrame, keys: str, table: ReferenceTable, out: str) -> DataFrame:
    """Add ``out``: an array aligned with the array column ``keys``, NULL where absent.

    All three ways give the same rows, whatever ids the rows have: where the table
    needs a join, blocks of rows ask it for their distinct keys.
    """
    if table.how != "inline":
        return _joined_lookup(frame, keys, table, out)
    return frame.withColumn(
        out, F.transform(keys, lambda key: inline_value(key, table.rows, table.value_type))
    )


def _placed(keys: pa.ChunkedArray, found: pa.Table, kind: pa.DataType) -> pa.Array:
    """For each list of keys the list of their values, NULL where ``found`` has none."""
    lists = keys.combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    at = pc.index_in(lists.flatten(), value_set=found["key"].combine_chunks(), skip_nulls=True)
    values = found["value"].combine_chunks().take(at)
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), dtype=np.int32)
    offsets = pa.array(np.r_[np.int32(0), ends], pa.int32())
    return pa.ListArray.from_arrays(offsets, values, mask=lists.is_null()).cast(kind)


def _joined_lookup(frame: DataFrame, keys: str, table: ReferenceTable, out: str) -> DataFrame:
    """Deal the rows into blocks, join the table to each block's distinct keys, and bring both together.

    Only distinct keys of a block meet the table, so frequent ones weigh no more than
    rare ones. Rows move once, to the hits of their block.
    """
    # Hashes of whole rows deal equal texts of several rows to several blocks.
    plain = [F.col(f"`{f.name}`") for f in frame.schema if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    number = F.pmod(F.xxhash64(*plain), F.lit(BLOCKS)).cast("int")
    asked = frame.select(number.alias("_block"), F.array_distinct(keys).alias("_asked")).repartition("_block")
    asked = asked.select("_block", F.explode("_asked").alias("key")).where("key IS NOT NULL").distinct()
    values = F.broadcast(table.frame) if table.how == "broadcast" else table.frame.hint("merge")
    found = asked.join(values, "key").select("_block", "key", "value")
    names = [name for name in frame.columns if name != out]
    rows = frame.select(number.alias("_block"), *(F.col(f"`{name}`") for name in names))
    added = StructType.fromDDL(f"`{out}` array<{table.value_type}>")
    schema = StructType([*(frame.schema[name] for name in names), *added])
    arrow = to_arrow_schema(schema)

    def place(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return arrow.empty_table()
        hits = _placed(left[keys], right, arrow.field(out).type)
        columns = [left[name].cast(arrow.field(name).type) for name in names]
        return pa.Table.from_arrays([*columns, hits], schema=arrow)

    return rows.groupBy("_block").cogroup(found.groupBy("_block")).applyInArrow(place, schema)


def reference_frame(spark: SparkSession, rows: Mapping[str, Any], value_type: str) -> DataFrame:
    """``rows`` as a (key, value) frame, for joining or for writing out."""
    schema = f"key string, value {value_type}"
    return spark.createDataFrame(list(rows.items()), schema)
