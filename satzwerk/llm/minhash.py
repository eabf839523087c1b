"""MinHash near-dedup as a Hamming join over many indexes.

A document is its set of word shingles; its signature are ``POSITIONS`` MinHash
values of ``BITS`` bits each. The distance of two signatures is the number of
positions that differ, for sets of similarity s about a share 1 - s of them. The
signature is cut into ``CHUNKS`` chunks of four positions. If two signatures
differ in fewer than twice as many positions as there are chunks, some chunk
holds one error at most (pigeonhole), so both chunks are equal once the right one
of four positions is left out. Each document is therefore indexed under every
chunk with every position left out, and all pairs within ``DISTANCE`` meet. Of
pairs at similarity 0.85 about 3.5 in a million lie beyond that distance and are
missed, at 0.8 about 144 in a million (binomial; a pair in a group of near copies
is still put together by its other links).

What meets within the distance is put together to clusters, and within a cluster
the links are confirmed on the full shingle sets, all against all. Both steps
compare in matrices, block by block, and give back only what connects; pairs are
never rows, and a group of any size is spread over many tasks. Documents with
equal sets are one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from satzwerk.llm.components import roots, spread
from satzwerk.llm.shared import per_text, saved

CHUNKS, CHUNK, BITS = 8, 4, 16
POSITIONS = CHUNKS * CHUNK
#: Signatures that differ in so many positions at most are sure to meet.
DISTANCE = 2 * CHUNKS - 1
#: Members of a bucket, and of a cluster, that meet in one task; shingles in one product.
BUCKET_BLOCK, CLUSTER_BLOCK, COLUMNS = 2048, 512, 4096
#: Words whose hash a worker remembers.
MEMO = 1 << 19

_random = np.random.default_rng(7)
_MULTIPLIERS = _random.integers(1, 1 << 63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = _random.integers(0, 1 << 63, POSITIONS, dtype=np.uint64)
_ORDER = _random.integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) >= MEMO:
            self.clear()
        self[word] = value
        return value


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case."""
    return (text or "").encode("utf-8").lower().split()


def shingle_set(text: str | None, width: int) -> set[tuple[bytes, ...]]:
    """The shingles themselves; with fewer words the whole sequence, without words none."""
    words = words_of(text)
    if len(words) < width:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(width))))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def hashed_shingles(words: list[bytes], width: int, known: _WordHash) -> np.ndarray:
    """The distinct shingles as ascending 64-bit hashes."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    width = min(width, len(words))
    hashes = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    count = len(words) - width + 1
    total = np.full(count, width, dtype=np.uint64)
    for i in range(width):
        total += _mixed(hashes[i : i + count] * _ORDER[i])
    return np.unique(_mixed(total))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The low bits of the smallest shingle under each of ``POSITIONS`` orders."""
    least = np.full(POSITIONS, np.uint64(2**64 - 1))
    for i in range(0, len(shingles), 4096):
        turned = (shingles[i : i + 4096, None] ^ _MASKS) * _MULTIPLIERS
        least = np.minimum(least, (turned >> np.uint64(20)).min(axis=0))
    return _mixed(least) & np.uint64((1 << BITS) - 1)


def index_keys(values: np.ndarray) -> list[int]:
    """A 64-bit key for each chunk and each of its positions left out."""
    chunks = values.reshape(CHUNKS, 1, CHUNK).repeat(CHUNK, axis=1)
    out = np.arange(CHUNK)
    chunks[:, out, out] = np.uint64(1 << BITS)  # no value: which one is left out, it says itself
    keys = np.full((CHUNKS, CHUNK), 0, dtype=np.uint64) + np.arange(1, CHUNKS + 1, dtype=np.uint64)[:, None]
    for position in range(CHUNK):
        keys = _mixed(keys * _ORDER[0] + chunks[:, :, position])
    return keys.reshape(-1).astype(np.int64).tolist()


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """Per row doc_id, n_shingles, a digest of the set, and its signature; no set has neither."""

    def start() -> Callable[[str | None], tuple]:
        known = _WordHash()

        def sign(text: str | None) -> tuple:
            shingles = hashed_shingles(words_of(text), width, known)
            if not len(shingles):
                return 0, None, None
            digest = xxhash.xxh3_128_digest(shingles.tobytes())
            return len(shingles), digest, signature(shingles).astype("<u2").tobytes()

        return sign

    return per_text(docs, start, "n_shingles bigint, digest binary, signature binary")


def index_entries(signed: DataFrame) -> DataFrame:
    """Each document under all keys of its signature: key, doc_id."""
    schema = "key bigint, doc_id bigint"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [index_keys(np.frombuffer(x, dtype="<u2").astype(np.uint64)) for x in batch.column(1).to_pylist()]
            at = pa.array(np.repeat(np.arange(len(keys)), list(map(len, keys))))
            flat = pa.array([key for some in keys for key in some], pa.int64())
            yield pa.RecordBatch.from_arrays([flat, batch.column(0).take(at)], schema=arrow)

    return signed.select("doc_id", "signature").mapInArrow(run, schema)


# --- comparing within groups ------------------------------------------------


def blocks_of(members: DataFrame, group: str, size: int) -> DataFrame:
    """Each member once for every pair of blocks of its group that it belongs to.

    A group of n members has about n / ``size`` blocks; adds block, block_a and
    block_b. Groups of more than one block are few, at most members / ``size``.
    """
    large = members.groupBy(group).agg(F.count("*").alias("_n")).where(F.col("_n") > size)
    large = large.select(group, F.ceil(F.col("_n") / size).cast("int").alias("_blocks"))
    blocks = F.coalesce("_blocks", F.lit(1))
    return (
        members.join(large, group, "left")
        .withColumn("block", F.pmod(F.xxhash64("doc_id"), blocks).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumn("block_a", F.least("block", "_other"))
        .withColumn("block_b", F.greatest("block", "_other"))
        .drop("_other", "_blocks")
    )


def connections(members: DataFrame, group: str, data: str, linked: Callable[[list], np.ndarray]) -> DataFrame:
    """What connects the members of each group: (u, v) with v the smallest that u reaches.

    ``linked`` makes the symmetric matrix of links of the values of ``data``. Only
    one row for each member that has a link leaves a task.
    """
    keys = (group, "block_a", "block_b")
    arrow = to_arrow_schema(StructType.fromDDL("u bigint, v bigint"))

    def compare(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if table.num_rows < 2:
            return
        table = table.sort_by("doc_id")
        ids = table["doc_id"].to_numpy()
        links = linked(table[data].to_pylist())
        if table["block_a"][0].as_py() != table["block_b"][0].as_py():
            block = table["block"].to_numpy()
            links &= block[:, None] != block[None, :]
        least = spread(links)
        some = np.flatnonzero(least != np.arange(len(ids)))
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(ids[least[some]])], schema=arrow)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            table = pa.Table.from_batches([*held, batch])
            columns = [table[k].to_numpy() for k in keys]
            edges = [0, *(np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1).tolist()]
            for start, end in zip(edges, edges[1:]):
                yield from compare(table.slice(start, end - start))
            held = table.slice(edges[-1]).combine_chunks().to_batches()
        if held:
            yield from compare(pa.Table.from_batches(held))

    placed = members.repartition(*keys).sortWithinPartitions(*keys)
    return placed.select(*keys, "block", "doc_id", data).mapInArrow(run, "u bigint, v bigint")


def within_distance(signed: list[bytes]) -> np.ndarray:
    """Which signatures differ in ``DISTANCE`` positions at most."""
    values = np.frombuffer(b"".join(signed), dtype="<u2").reshape(len(signed), POSITIONS)
    apart = np.zeros((len(signed), len(signed)), dtype=np.uint8)
    for position in range(POSITIONS):
        apart += values[:, None, position] != values[None, :, position]
    return apart <= DISTANCE


def similar(texts: list[str], width: int, percent: int, known: _WordHash) -> np.ndarray:
    """Which full sets reach the similarity, by counts of common shingles.

    Shingles of one text alone add to no intersection and are left out of the product.
    """
    sets = [hashed_shingles(words_of(text), width, known) for text in texts]
    sizes = np.array(list(map(len, sets)))
    names, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    several = times[place] > 1
    owner, column = owner[several], (np.cumsum(times > 1) - 1)[place[several]]
    common = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for first in range(0, int((times > 1).sum()), COLUMNS):
        here = (column >= first) & (column < first + COLUMNS)
        holds = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        holds[owner[here], column[here] - first] = 1
        common += holds @ holds.T
    common = common.astype(np.int64)
    return 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)


def links(reps: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Confirmed connections (u, v) among documents with one set each.

    ``reps`` has the doc_id and signature of one document for each set.
    """
    entries = index_entries(reps)
    shared = entries.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    meeting = saved(entries.join(shared, "key"), "minhash-entries")
    placed = blocks_of(meeting, "key", BUCKET_BLOCK).join(reps, "doc_id")
    close = connections(placed, "key", "signature", within_distance)
    clusters = roots(close)
    members = clusters.unionByName(clusters.select(F.col("root").alias("u"), "root").distinct())
    texts = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    texts = saved(
        texts.join(members.withColumnRenamed("u", "doc_id").withColumnRenamed("root", "cluster"), "doc_id"), "minhash-texts"
    )
    known = _WordHash()
    return connections(
        blocks_of(texts, "cluster", CLUSTER_BLOCK), "cluster", "text", lambda some: similar(some, width, percent, known)
    )


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per row doc_id, n_shingles, component_id (the smallest doc_id reachable) and kept.

    NULL and empty texts, and those of white space alone, have no shingles and
    link with nothing. Texts of fewer words than a shingle link with equal word
    sequences. A NULL doc_id links with nothing and is kept. Rows of one doc_id
    are one document with the links of all. Columns other than doc_id and text do
    not matter; an empty table gives an empty one.
    """
    rows = saved(signatures(docs, width), "minhash-signatures")
    usable = rows.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    groups = usable.groupBy("digest").agg(F.min("doc_id").cast("bigint").alias("rep"))
    # The signature of a set is the same in every row of it; its first document brings it.
    reps = usable.join(groups, "digest").where("doc_id = rep").select(F.col("rep").alias("doc_id"), "signature").distinct()
    found = links(reps, docs, width, percent)
    same = usable.select("doc_id", "digest").join(groups, "digest").where("doc_id <> rep")
    every = found.unionByName(same.select(F.col("rep").alias("u"), F.col("doc_id").cast("bigint").alias("v")))
    reached = roots(every).withColumnRenamed("u", "_id")
    component = F.coalesce("root", "doc_id")
    return (
        rows.join(reached, F.col("doc_id") == F.col("_id"), "left")
        .select("doc_id", "n_shingles", component.alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def keep_first(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents without those that have a smaller one in their component."""
    dropped = near_duplicates(docs, width, percent).where("NOT kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(docs.columns)
