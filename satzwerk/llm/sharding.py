"""Sharding by fixed virtual slots.

Records hash into a fixed number of slots. A small table, the slot map, says
which shard holds which slot; its versions are kept side by side. Adding a shard
or evening out bytes edits the map, so that only the slots named in the edit move
and no record is ever hashed anew.

The map has ``slots`` rows (4,096 here, at most ``MAX_SLOTS``) however large the
data is; that bound is why it may be built on the driver and broadcast.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from satzwerk.llm.shared import saved

SLOTS = 4096
MAX_SLOTS = 65_536
MAP_TYPE = "version int, slot int, shard int"


def virtual_slot(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key, the same for ever; a NULL key has one as well."""
    return F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.lit(""))), F.lit(slots)).cast("int")


def grown(owners: list[int]) -> list[int]:
    """One more shard: it takes an even share of slots, always from the fullest."""
    held: dict[int, list[int]] = {}
    for slot, shard in enumerate(owners):
        held.setdefault(shard, []).append(slot)
    new, out = max(held) + 1, list(owners)
    fullest = [(-len(slots), shard) for shard, slots in held.items()]
    heapq.heapify(fullest)
    for _ in range(len(owners) // (len(held) + 1)):
        count, shard = heapq.heappop(fullest)
        out[held[shard].pop()] = new
        heapq.heappush(fullest, (count + 1, shard))
    return out


def first_map(shards: int, slots: int = SLOTS) -> list[int]:
    """The map of so many shards: grown from one, so the shard count alone decides."""
    if not 1 <= shards <= slots <= MAX_SLOTS:
        raise ValueError(f"need 1 <= shards <= slots <= {MAX_SLOTS}")
    owners = [0] * slots
    for _ in range(shards - 1):
        owners = grown(owners)
    return owners


def rebalanced(owners: list[int], slot_bytes: dict[int, int], tolerance: float = 0.01) -> list[int]:
    """Move single slots from the fullest to the emptiest shard.

    Ends when the fullest is within ``tolerance`` of the mean or no move helps.
    """
    out = list(owners)
    shards = sorted(set(owners))
    load = dict.fromkeys(shards, 0)
    for slot, shard in enumerate(out):
        load[shard] += slot_bytes.get(slot, 0)
    mean = sum(load.values()) / len(shards)
    while True:
        high, low = max(shards, key=load.get), min(shards, key=load.get)
        gap = load[high] - load[low]
        movable = [s for s, x in enumerate(out) if x == high and 0 < slot_bytes.get(s, 0) < gap]
        if load[high] <= mean * (1 + tolerance) or not movable:
            return out
        slot = min(movable, key=lambda s: (abs(gap / 2 - slot_bytes[s]), s))
        out[slot] = low
        load[high] -= slot_bytes[slot]
        load[low] += slot_bytes[slot]


def map_frame(spark: SparkSession, versions: list[list[int]]) -> DataFrame:
    """The versions of a map as rows, numbered from 1."""
    rows = [
        (number, slot, shard)
        for number, owners in enumerate(versions, 1)
        for slot, shard in enumerate(owners)
    ]
    return spark.createDataFrame(rows, MAP_TYPE)


def write_map(spark: SparkSession, path: str, versions: list[list[int]]) -> None:
    map_frame(spark, versions).coalesce(1).write.mode("overwrite").parquet(path)


def read_map(spark: SparkSession, path: str) -> list[list[int]]:
    """All versions, oldest first; bounded by slots times versions."""
    versions: dict[int, dict[int, int]] = {}
    for row in spark.read.schema(MAP_TYPE).parquet(path).collect():
        versions.setdefault(row.version, {})[row.slot] = row.shard
    return [[versions[v][s] for s in sorted(versions[v])] for v in sorted(versions)]


def slot_sizes(records: DataFrame) -> DataFrame:
    """Rows and bytes of each slot that has any: at most one row per slot."""
    return records.groupBy("virtual_slot").agg(
        F.count("*").alias("slot_rows"), F.sum("size").alias("slot_bytes")
    )


def slot_bytes(records: DataFrame) -> dict[int, int]:
    """Bytes by slot for ``rebalanced``: at most ``MAX_SLOTS`` rows."""
    return {row.virtual_slot: row.slot_bytes for row in slot_sizes(records).collect()}


def records_of(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Per document its id, size, checksum and slot.

    The size is the bytes of the text plus one. A NULL text counts as empty.
    """
    data = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return docs.select(
        F.col("doc_id"),
        (F.octet_length(data) + 1).cast("bigint").alias("size"),
        F.crc32(data).alias("text_crc32"),
        virtual_slot(F.col("doc_id"), slots).alias("virtual_slot"),
    )


def shard(records: DataFrame, owners: list[int], later: list[int] | None = None) -> DataFrame:
    """Place records by a map: their shard, their place in it, and the shard of a later map.

    ``slot`` counts the rows of a shard from 0 without gaps: slots one after the
    other, within a slot by doc_id, checksum and size; equal rows are
    interchangeable. Only rows of one virtual slot are sorted together. An empty
    table gives an empty one.
    """
    spark = records.sparkSession
    later = later or [None] * len(owners)
    places = F.broadcast(
        spark.createDataFrame(
            [(slot, *pair) for slot, pair in enumerate(zip(owners, later, strict=True))],
            "virtual_slot int, shard int, grown_shard int",
        )
    )
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        slot_sizes(records)
        .join(places, "virtual_slot")
        .withColumn("_before", F.coalesce(F.sum("slot_rows").over(before), F.lit(0)))
    )
    within = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return (
        records.withColumn("_place", F.row_number().over(within) - 1)
        .join(F.broadcast(offsets), "virtual_slot")
        .withColumn("slot", (F.col("_before") + F.col("_place")).cast("bigint"))
        .drop("_before", "_place", "slot_rows")
    )


def shard_documents(docs: DataFrame, shards: int = 8, slots: int = SLOTS) -> DataFrame:
    """All documents in ``shards`` shards, and where they go with one more.

    The law is ``key``: doc_id and the number of shards decide, and one more shard
    takes rows only into itself. Texts are read once; the rest runs on the saved
    ids, sizes and checksums. Columns of ``docs`` other than doc_id and text are
    not looked at.
    """
    records = saved(records_of(docs, slots), "shard-records")
    owners = first_map(shards, slots)
    return shard(records, owners, grown(owners)).withColumn("law", F.lit("key"))
