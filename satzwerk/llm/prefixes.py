"""A trie of all beginnings of conversations, as tables of nodes by perfect hash.

Conversations are rebuilt from a shared beginning and their own turns. Each
distinct sequence of their first turns is a node.

1. Rows are sorted by conversation and turn into ranges, so that a conversation of
   very many turns lies in many tasks. The digest of the first d turns is a
   polynomial in the digests of the turns, modulo a prime, twice: what two tasks
   hold of one conversation is put together by one multiplication, and so are a
   shared beginning and the turns behind it.
2. Every node belongs to its smallest conversation, which owns its whole path from
   the first such node on. With that known, all that a node sums up over its
   subtree is a sum over the conversations that pass it: each of them adds its last
   turn if it is a leaf that it owns, and the bytes of the turns that it shares
   with smaller ones. No subtree has to be in one place.
3. Each shard, any rows of any conversations, enumerates the distinct digests in
   it, gives each a slot by a minimal perfect hash and verifies it there, scatters
   what its conversations add into flat arrays by slot, and adds these up to the
   parents' slots, the deepest first. Equal nodes of all shards are then summed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from satzwerk.llm.shared import forget, saved

PRIME = (1 << 61) - 1
BASES = (0x1B873593CC9E2D51 % PRIME, 0x0E6546B64F3A7C15 % PRIME)
#: Rows in a shard.
SHARD = 1 << 17
#: Characters of role and text by which rows of one turn are put in order; then a digest decides.
ORDERED = 256
#: No shared beginning is longer.
HEAD = 8
#: Ids that are put together before they are sent to be hashed.
JOINED = 512

TURNS = "conv_id bigint, part int, pos bigint, h1 bigint, h2 bigint, q1 bigint, q2 bigint, bytes bigint, upto bigint, last boolean"
ROWS = "conv_id bigint, depth bigint, k1 bigint, k2 bigint, p1 bigint, p2 bigint, bytes bigint, before bigint, turns bigint"
SUMS = "depth bigint, k1 bigint, k2 bigint, p1 bigint, p2 bigint, conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint"


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


# --- turns in order ---------------------------------------------------------


def in_order(rows: DataFrame) -> DataFrame:
    """All turns with their place and digest inside what a task holds of a conversation."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = rows.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.substring(F.concat(role, F.lit("\0"), text), 1, ORDERED).alias("start"),
        F.sha2(said, 256).alias("digest"), F.octet_length(text).cast("bigint").alias("bytes"), F.monotonically_increasing_id().alias("any"),
    )
    keys = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("start"), F.col("digest"), F.col("any")]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).select("conv_id", F.spark_partition_id(), "digest", "bytes")
    arrow = to_arrow_schema(StructType.fromDDL(TURNS))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, held = None, None
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != conv:
                    conv, pos, h, powers, upto = row[0], 0, (0, 0), (1, 1), 0
                    if held is not None:
                        out.append((*held, True))
                elif held is not None:
                    out.append((*held, False))
                pos, q = pos + 1, h
                powers = tuple(p * b % PRIME for p, b in zip(powers, BASES, strict=True))
                turn = int(row[2][:16], 16), int(row[2][16:32], 16)
                h = tuple((a + t * p) % PRIME for a, t, p in zip(h, turn, powers, strict=True))
                upto += row[3]
                held = (conv, row[1], pos, *h, *q, row[3], upto)
            yield _batch(arrow, out)
        if held is not None:
            yield _batch(arrow, [(*held, True)])

    return placed.mapInArrow(run, TURNS)


def joined_up(turns: DataFrame) -> DataFrame:
    """The turns with places and digests from the start of their conversation.

    Only what the first conversation of a task had in the tasks before it comes to
    the driver: two rows for a task at most.
    """
    ends = turns.where("last").select("part", "conv_id", "pos", "h1", "h2", "upto")
    edges = ends.groupBy("part").agg(F.min("conv_id").alias("low"), F.max("conv_id").alias("high"))
    spanning = ends.join(edges, "part").where("conv_id IN (low, high)").select(*ends.columns)
    before, shift = {}, {}
    for part, conv, pos, h1, h2, upto in sorted(map(tuple, spanning.collect())):
        n, hashes, size = before.get(conv, (0, (0, 0), 0))
        if n:
            shift[part, conv] = n, hashes, size
        hashes = tuple((a + h * pow(b, n, PRIME)) % PRIME for a, h, b in zip(hashes, (h1, h2), BASES, strict=True))
        before[conv] = n + pos, hashes, size + upto
    if not shift:
        return turns
    arrow = to_arrow_schema(StructType.fromDDL(TURNS))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                moved = shift.get((row[1], row[0]))
                if moved:
                    n, hashes, size = moved
                    h = [(a + x * pow(b, n, PRIME)) % PRIME for a, x, b in zip(hashes * 2, row[3:7], BASES * 2, strict=True)]
                    row = (row[0], row[1], row[2] + n, *h, row[7], row[8] + size, row[9])
                out.append(row)
            yield _batch(arrow, out)

    return turns.mapInArrow(run, TURNS)


# --- rebuilt conversations --------------------------------------------------


def shared_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first of its five."""
    return F.crc32(conv_id.cast("string").cast("binary")) % (HEAD + 1)


def rebuilt(turns: DataFrame) -> DataFrame:
    """A row for each conversation and depth, the root included, with the digests of node and parent."""
    heads = turns.where(F.col("pos") <= HEAD).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "h1", "h2", "bytes", "upto"))).alias("head"))
    convs = turns.groupBy("conv_id").agg(F.max("pos").alias("n")).join(heads, "conv_id").withColumn("h", shared_turns(F.col("conv_id")))
    bases = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"), F.col("head").alias("base_head"))
    plans = convs.withColumn("base", F.expr("conv_id - conv_id % 5")).join(bases, "base", "left")
    plans = saved(
        plans.withColumn("g", F.least("h", F.coalesce("base_n", F.lit(0)))).select(
            "conv_id", "h", "g", (F.col("g") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("turns"),
            F.expr("slice(base_head, 1, CAST(g AS INT))").alias("shared"),
            F.expr("get(base_head, CAST(g AS INT) - 1)").alias("stem"),
            F.expr("get(head, CAST(h AS INT) - 1)").alias("cut"),
        ),
        "prefix-plans",
    )
    root = plans.selectExpr("conv_id", "0L AS depth", "0L AS k1", "0L AS k2", "NULL AS p1", "NULL AS p2", "0L AS bytes", "0L AS before", "turns")
    first = plans.select("conv_id", "turns", "shared", F.explode("shared").alias("t")).selectExpr(
        "conv_id", "t.pos AS depth", "t.h1 AS k1", "t.h2 AS k2", "COALESCE(get(shared, CAST(t.pos AS INT) - 2).h1, 0L) AS p1",
        "COALESCE(get(shared, CAST(t.pos AS INT) - 2).h2, 0L) AS p2", "t.bytes", "t.upto - t.bytes AS before", "turns",
    )
    own = turns.join(plans.drop("shared"), "conv_id").where("pos > h").selectExpr(
        "conv_id", "pos", "h", "g", "h1", "h2", "q1", "q2", "bytes", "upto", "turns",
        *(f"COALESCE({s}.{c}, 0L) AS {s}_{c}" for s in ("stem", "cut") for c in ("h1", "h2", "upto")),
    )
    arrow = to_arrow_schema(StructType.fromDDL(ROWS))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = {(b, n): pow(b, n, PRIME) for b in BASES for n in range(-HEAD, HEAD + 1)}
        for batch in batches:
            out = []
            for conv, pos, h, g, h1, h2, q1, q2, size, upto, n, s1, s2, s_upto, c1, c2, c_upto in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys = [
                    (stem + (x - cut) * powers[b, g - h]) % PRIME
                    for x, stem, cut, b in zip((h1, h2, q1, q2), (s1, s2) * 2, (c1, c2) * 2, BASES * 2, strict=True)
                ]
                out.append((conv, g + pos - h, *keys, size, s_upto + upto - size - c_upto, n))
            yield _batch(arrow, out)

    return root.unionByName(first).unionByName(own.mapInArrow(run, ROWS))


# --- shards -----------------------------------------------------------------


def _hash(keys: np.ndarray, level: int) -> np.ndarray:
    mixed = np.full(len(keys), 0x9E3779B97F4A7C15 * (2 * level + 1) & (2**64 - 1), dtype=np.uint64)
    for column in keys.T:
        mixed = (mixed ^ column.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(31)
    return mixed


class Slots:
    """A minimal perfect hash of distinct keys (rows of numbers) that knows its keys.

    Level by level a key is placed where no other one falls; the rest goes on to the
    next level (Limasset et al. 2017). The slot is the number of placed bits before.
    """

    def __init__(self, keys: np.ndarray):
        self.bits, left = [], np.arange(len(keys))
        while len(left):
            size = 2 * len(left) + 1
            at = (_hash(keys[left], len(self.bits)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            self.bits.append(alone)
            left = left[~alone[at]]
        self.ranks = np.cumsum([0, *(int(b.sum()) for b in self.bits)])
        self.before = [np.cumsum(b) - 1 for b in self.bits]
        self.keys = np.zeros_like(keys)
        self.keys[self._slot(keys)] = keys

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        slots, left = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        for level, bits in enumerate(self.bits):
            at = (_hash(keys[left], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            slots[left[hit]] = self.ranks[level] + self.before[level][at[hit]]
            left = left[~hit]
        return slots

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The slots of keys; -1 for each that is not the key kept at its slot."""
        slots = self._slot(keys)
        if not len(self.keys):
            return slots
        return np.where((self.keys[slots] == keys).all(axis=1), slots, -1)


def shard_sums(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """What the rows of a shard add to its nodes.

    Rows are sorted by conv_id and depth. A stretch of one conversation scatters what
    it adds to all its nodes at its deepest one; at the parent of its first node it
    takes that off again, as the rows above it may lie in another shard.
    """
    conv, depth = rows["conv_id"], rows["depth"]
    keys = np.stack([depth, rows["k1"], rows["k2"]], axis=1)
    up = np.stack([depth - 1, rows["p1"], rows["p2"]], axis=1)
    begins = np.ones(len(conv), dtype=bool)
    begins[1:] = (conv[1:] != conv[:-1]) | (depth[1:] != depth[:-1] + 1)
    ends = np.r_[begins[1:], True]
    outer = begins & (depth > 0)
    slots = Slots(np.unique(np.concatenate([keys, up[outer]]), axis=0))
    n = len(slots.keys)
    at, above = slots.of(keys), slots.of(up)
    parent, least = np.full(n, -1, dtype=np.int64), np.full(n, np.iinfo(np.int64).max)
    inner = depth > 0
    parent[at[inner]] = above[inner]
    np.minimum.at(least, at, conv)
    sums = {name: np.zeros(n, dtype=np.int64) for name in ("n_convs", "n_children", "n_leaves", "saved_tokens")}
    np.add.at(sums["n_convs"], at[ends], 1)
    np.add.at(sums["n_convs"], above[outer], -1)
    np.add.at(sums["n_leaves"], at[ends], rows["leaf"][ends])
    np.add.at(sums["n_leaves"], above[outer], -rows["leaf"][outer])
    # The bytes of a conversation's turns from a place on to the last one that a smaller one has.
    rest = lambda upto: np.maximum(rows["owned_before"] - upto, 0)
    shared = depth < rows["owned"]
    np.add.at(sums["saved_tokens"], at[shared], rows["bytes"][shared])
    np.add.at(sums["saved_tokens"], at[ends], rest(rows["before"] + rows["bytes"])[ends])
    np.add.at(sums["saved_tokens"], above[outer], -rest(rows["before"])[outer])
    order = np.argsort(-slots.keys[:, 0], kind="stable")
    for level in np.split(order, np.flatnonzero(np.diff(slots.keys[order, 0])) + 1):
        level = level[parent[level] >= 0]
        for name in ("n_convs", "n_leaves", "saved_tokens"):
            np.add.at(sums[name], parent[level], sums[name][level])
    mine = ~shared & inner  # an owned node is one child of its parent
    np.add.at(sums["n_children"], above[mine], 1)
    some = least < np.iinfo(np.int64).max
    some |= np.any([s != 0 for s in sums.values()], axis=0)
    p = np.zeros((n, 2), dtype=np.int64)
    p[at] = up[:, 1:]
    real = np.zeros(n, dtype=bool)
    real[at[inner]] = True
    found = dict(zip(("depth", "k1", "k2"), slots.keys.T, strict=True)) | {"p1": p[:, 0], "p2": p[:, 1], "conv_id": least} | sums
    return {k: v[some] for k, v in found.items()} | {"real": real[some], "has": (least < np.iinfo(np.int64).max)[some]}


def node_sums(rows: DataFrame) -> DataFrame:
    """All nodes with their sums over conversations; the owner is conv_id."""
    nodes = rows.groupBy("depth", "k1", "k2").agg(F.min("conv_id").alias("owner"), F.max("turns").alias("longest"), F.min("before").alias("before"))
    owners = nodes.groupBy(F.col("owner").alias("conv_id")).agg(
        F.min("depth").alias("owned"), F.min("before").alias("owned_before"), F.max((F.col("depth") == F.col("longest")).cast("bigint")).alias("leaf")
    )
    # Who owns no node shares all turns; the largest number stands for the bytes of all of them.
    whole = rows.where("depth = turns").select("conv_id", (F.col("before") + F.col("bytes")).alias("size"))
    owners = whole.join(owners, "conv_id", "left").select(
        "conv_id", F.coalesce("owned", F.lit(2**62)).alias("owned"), F.coalesce("owned_before", "size").alias("owned_before"), F.coalesce("leaf", F.lit(0)).alias("leaf")
    )
    joined = rows.join(owners, "conv_id").sortWithinPartitions("conv_id", "depth")
    columns = joined.columns
    arrow = to_arrow_schema(StructType.fromDDL(SUMS))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shard(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            found = shard_sums({c: table[c].fill_null(0).to_numpy() for c in columns})
            mask = {"p1": ~found["real"], "p2": ~found["real"], "conv_id": ~found["has"]}
            return pa.RecordBatch.from_arrays([pa.array(found[f.name], f.type, mask=mask.get(f.name)) for f in arrow], schema=arrow)

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= SHARD:
                yield shard(held)
                held, size = [], 0
        if size:
            yield shard(held)

    sums = joined.mapInArrow(run, SUMS)
    added = (F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"))
    return sums.groupBy("depth", "k1", "k2").agg(F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.min("conv_id").alias("conv_id"), *added)


def end_digests(rows: DataFrame) -> DataFrame:
    """For each node where conversations end the SHA-256 of their ids, ascending.

    Ids are put together in ranges, many of one node in many tasks; one task hashes
    the joined pieces of a node as they come, in order, and holds one of them at a time.
    """
    keys = ["depth", "k1", "k2"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = rows.where("depth = turns").select(*keys, "conv_id")
    ends = ends.repartitionByRange(n, *keys, "conv_id").sortWithinPartitions(*keys, "conv_id")
    pieces = "depth bigint, k1 bigint, k2 bigint, first bigint, ids string"
    digests = "depth bigint, k1 bigint, k2 bigint, ends_sha256 string"
    piece_arrow, digest_arrow = (to_arrow_schema(StructType.fromDDL(t)) for t in (pieces, digests))

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids = None, []
        for batch in batches:
            out = []
            for *key, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != node or len(ids) == JOINED:
                    if ids:
                        out.append((*node, ids[0], ",".join(map(str, ids))))
                    node, ids = key, []
                ids.append(conv)
            yield _batch(piece_arrow, out)
        if ids:
            yield _batch(piece_arrow, [(*node, ids[0], ",".join(map(str, ids)))])

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            out = []
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 4)), strict=True):
                if key != node:
                    if node is not None:
                        out.append((*node, state.hexdigest()))
                    node, state = key, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            yield _batch(digest_arrow, out)
        if node is not None:
            yield _batch(digest_arrow, [(*node, state.hexdigest())])

    joined = ends.mapInArrow(join, pieces)
    return joined.repartition(n, *keys).sortWithinPartitions(*keys, "first").mapInArrow(digest, digests)


# --- the operator -----------------------------------------------------------


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations (conv_id, turn, role, text), a row per node.

    Rebuilt from conversation c: the first h turns of conversation c - c % 5 (as SQL
    takes the remainder of negative numbers, towards zero), then its own behind the
    first h, where h is crc32 of the decimal c, modulo 9.

    Columns: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256. Turns go by turn, NULL first; rows of one turn by role
    and text as far as ``ORDERED`` characters, then by a digest, and repeated rows are
    turns of their own. NULL role or text counts as empty; a row without conv_id is in
    no conversation. Other columns do not matter. An empty table gives an empty one,
    without a root. Equal digests of 122 bits count as equal turns.
    """
    started = saved(in_order(conversations), "prefix-turns")
    turns = saved(joined_up(started), "prefix-turns")
    rows = saved(rebuilt(turns), "prefix-rows")
    nodes = saved(node_sums(rows), "prefix-nodes")
    upper = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    none = hashlib.sha256(b"").hexdigest()
    found = nodes.join(end_digests(rows), ["depth", "k1", "k2"], "left").join(upper, ["depth", "p1", "p2"], "left")
    found = found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256")
    )
    for part in (started, turns):
        forget(part)
    return found
