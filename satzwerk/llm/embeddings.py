"""Near duplicates among embeddings by spherical-cap filters.

Filters are directions. A vector falls into every filter whose direction it
exceeds: inner product at least ``HEIGHT`` standard deviations of a random one.
Close vectors share filters, others hardly ever. The directions form product
codes: the dimensions are turned at random and cut into parts, each part has
``CODES`` random unit vectors, and a direction is one of them for each part, so
2 x 32 vectors stand for 1,024 directions. A vector is decoded to its list of
filters part by part, dropping what cannot reach the height any more. ``TABLES``
codes, each turned its own way, even out how many filters a vector gets.

Vectors of one label meet in their common filters; the cosine is verified there
in double precision. A pair counts in the first filter it shares, so nothing is
counted twice and no pair needs to leave its task.

With these values a vector has 51 filters on average. Of 3,282 pairs each at
cosine 0.931 and 0.98 none went without a common filter; with a single code of
22,500 directions and 22 filters a vector it had been one in ten, as some vectors
then have hardly any.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from satzwerk.llm.components import roots, spread
from satzwerk.llm.shared import saved

THRESHOLD = 0.93
TABLES, PARTS, CODES, HEIGHT = 12, 2, 32, 2.6
#: The greatest inner product that a filter asks for.
MOST = 0.6
#: Vectors of a bucket that one task compares at once; larger buckets are split.
BLOCK = 2048

KEYS = ("label", "size", "filter", "block_a", "block_b")


class Code:
    """The product codes for vectors of one dimension, each turned its own way."""

    def __init__(
        self, size: int, tables: int = TABLES, parts: int = PARTS, codes: int = CODES, height: float = HEIGHT
    ):
        parts = min(parts, size)
        cuts = np.array_split(np.arange(size), parts)
        random = np.random.default_rng(size)
        self.tables = []
        for _ in range(tables):
            turn = np.linalg.qr(random.standard_normal((size, size)))[0]
            words = [random.standard_normal((codes, len(cut))) for cut in cuts]
            words = [w / np.linalg.norm(w, axis=1, keepdims=True) for w in words]
            self.tables.append([turn[:, cut] @ w.T for cut, w in zip(cuts, words, strict=True)])
        # A direction is its words side by side, divided by the root of their number.
        # In few dimensions no inner product is so many deviations large.
        self.need = min(height / np.sqrt(size), MOST) * np.sqrt(parts)
        self.codes, self.in_table = codes, codes**parts

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of a row and a filter that it exceeds, by row, then filter.

        Part by part, a beginning is dropped once the best that the other parts
        offer its row cannot lift it to the height.
        """
        rows, filters = [], []
        for number, table in enumerate(self.tables):
            scores = [unit @ words for words in table]
            best = np.array([s.max(axis=1) for s in scores])
            rest = np.cumsum(best[::-1], axis=0)[::-1] - best  # what parts after k can add at most
            row, total = np.arange(len(unit)), np.zeros(len(unit))
            code = np.zeros(len(unit), dtype=np.int64)
            for part, most in zip(scores, rest, strict=True):
                grid = total[:, None] + part[row]
                a, b = np.nonzero(grid >= self.need - most[row][:, None])
                row, total, code = row[a], grid[a, b], code[a] * self.codes + b
            rows.append(row)
            filters.append(code + number * self.in_table)
        rows, filters = np.concatenate(rows), np.concatenate(filters)
        order = np.argsort(rows, kind="stable")
        return rows[order], filters[order]


def _usable(embedding: Column) -> Column:
    """Whether a vector has a direction: no NULL, nothing that is not finite, not zero."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    return F.coalesce(fine & F.exists(embedding, lambda x: x != 0), F.lit(False))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision; the largest entry is taken out first."""
    vectors = vectors.astype(np.float64)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _by_dimension(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and vectors of a batch, 512 at a time, one dimension after the other."""
    lists = batch.column("embedding")
    starts, lengths = lists.offsets.to_numpy()[:-1], np.diff(lists.offsets.to_numpy())
    flat = lists.values.to_numpy(zero_copy_only=False)
    for size in np.unique(lengths):
        rows = np.flatnonzero(lengths == size)
        for i in range(0, len(rows), 512):
            some = rows[i : i + 512]
            yield some, flat[starts[some][:, None] + np.arange(size)]


def filter_entries(vectors: DataFrame, with_vectors: bool, **code) -> DataFrame:
    """A row for each vector and filter: label, size, filter, vec_id, weight, vector, smaller.

    ``smaller`` lists the smaller filters of the vector. Without vectors only the
    keys, and n = 1 to be summed.
    """
    schema = StructType.fromDDL(
        f"label {vectors.schema['label'].dataType.simpleString()}, size int, filter int, "
        + ("vec_id bigint, weight bigint, vector binary, smaller binary" if with_vectors else "n bigint")
    )
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, Code] = {}
        for batch in batches:
            for rows, vectors in _by_dimension(batch):
                size = vectors.shape[1]
                if size not in known:
                    known[size] = Code(size, **code)
                at, filters = known[size].decode(unit(vectors))
                take = pa.array(rows[at])
                columns = [
                    batch.column("label").take(take),
                    pa.array(np.full(len(at), size, dtype=np.int32)),
                    pa.array(filters.astype(np.int32)),
                ]
                if with_vectors:
                    lists, firsts = filters.astype("<i4").tobytes(), np.searchsorted(at, at)
                    smaller = [lists[4 * f : 4 * i] for i, f in enumerate(firsts.tolist())]
                    data = pa.array([x.astype("<f4").tobytes() for x in vectors], pa.binary())
                    columns += [batch.column(c).take(take) for c in ("vec_id", "weight")]
                    columns += [data.take(pa.array(at)), pa.array(smaller, pa.binary())]
                else:
                    columns.append(pa.array(np.ones(len(at), dtype=np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow
                )

    return vectors.select("label", "vec_id", "weight", "embedding").mapInArrow(run, schema)


def compare(ids, weights, units, smaller, blocks, crossing: bool, threshold: float):
    """Links of one bucket (or of two blocks of it): per linked row its id, weight of new links, root.

    A link counts here if no smaller filter holds both; as a connection it is used anyway.
    """
    linked = units @ units.T >= threshold
    if crossing:
        linked &= blocks[:, None] != blocks[None, :]
    np.fill_diagonal(linked, False)
    rows = np.flatnonzero(linked.any(axis=1))
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    linked = linked[np.ix_(rows, rows)]
    smaller = [smaller[r] for r in rows]
    names, place = np.unique(np.concatenate(smaller), return_inverse=True)
    holds = np.zeros((len(rows), len(names)), dtype=np.float32)
    holds[np.repeat(np.arange(len(rows)), [len(x) for x in smaller]), place] = 1
    new = linked & (holds @ holds.T < 0.5)
    return ids[rows], new @ weights[rows], ids[rows][_least_id(spread(linked), ids[rows])]


def _least_id(label: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each row the row with the smallest id of its label."""
    order = np.lexsort((ids, label))
    first = order[np.r_[True, label[order][1:] != label[order][:-1]]]
    place = np.searchsorted(label[first], label)
    return first[place]


FOUND_TYPE = "vec_id bigint, links bigint, root bigint"


def bucket_links(entries: DataFrame, threshold: float) -> DataFrame:
    """Compare within buckets; the entries must be grouped by ``KEYS`` in their partitions."""
    arrow = to_arrow_schema(StructType.fromDDL(FOUND_TYPE))

    def bucket(group: pa.Table) -> Iterator[pa.RecordBatch]:
        if group.num_rows < 2:
            return
        vectors = np.frombuffer(b"".join(group["vector"].to_pylist()), dtype="<f4")
        found = compare(
            group["vec_id"].to_numpy(),
            group["weight"].to_numpy(),
            unit(vectors.reshape(group.num_rows, -1)),
            [np.frombuffer(x, dtype="<i4") for x in group["smaller"].to_pylist()],
            group["block"].to_numpy(),
            group["block_a"][0].as_py() != group["block_b"][0].as_py(),
            threshold,
        )
        if len(found[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], schema=arrow)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held)
            keys = [table[k].to_numpy() for k in KEYS]
            starts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            edges = [0, *starts.tolist()]
            for a, b in zip(edges, edges[1:]):
                yield from bucket(table.slice(a, b - a))
            held = table.slice(edges[-1]).combine_chunks().to_batches()
        if held:
            yield from bucket(pa.Table.from_batches(held))

    return entries.mapInArrow(run, FOUND_TYPE)


def near_duplicates(
    embeddings: DataFrame, threshold: float = THRESHOLD, parts: int = PARTS, codes: int = CODES,
    height: float = HEIGHT, tables: int = TABLES,
) -> DataFrame:
    """Per vector vec_id, n_links, component_id and kept.

    Vectors link if their labels are equal and not NULL, their dimensions equal
    and their cosine at least ``threshold``. A vector that is NULL, empty, zero or
    holds NULL or what is not finite links with nothing, nor does one without
    vec_id, whose component_id is NULL. Equal vectors of a label
    are one vector with a weight, so copies never meet as pairs; they link with
    each other and share all links. Repeated rows count as vectors of their own.
    ``component_id`` is the smallest vec_id reachable. More filters (a lower
    height, more codes) raise the recall; a greater height with more codes suits
    more vectors. Other columns do not matter; an empty table gives an empty one.
    """
    code = {"tables": tables, "parts": parts, "codes": codes, "height": height}
    same = F.transform("embedding", lambda x: x + F.lit(0.0).cast("float"))  # no negative zero
    rows = embeddings.select("vec_id", "label", same.alias("embedding")).withColumn(
        "usable", _usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    )
    digest = [F.xxhash64("label", "embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding", "label").alias("h2")]
    usable = rows.where("usable").select("vec_id", "label", "embedding", *digest)
    groups = saved(
        usable.groupBy("label", "h1", "h2").agg(
            F.min("vec_id").alias("vec_id"), F.count("*").alias("weight"), F.first("embedding").alias("embedding")
        ),
        "vectors",
    )

    # Buckets larger than a block meet block by block: as many rows as there are such buckets.
    sizes = filter_entries(groups, False, **code).groupBy("label", "size", "filter").agg(F.sum("n").alias("n"))
    large = sizes.where(F.col("n") > BLOCK).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    entries = filter_entries(groups, True, **code).join(
        large.drop("n"), ["label", "size", "filter"], "left"
    )
    blocks = F.coalesce("blocks", F.lit(1))
    entries = (
        entries.withColumn("block", F.pmod(F.xxhash64("vec_id"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumn("block_a", F.least("block", "other"))
        .withColumn("block_b", F.greatest("block", "other"))
        .drop("other", "blocks")
    )
    found = saved(
        bucket_links(entries.repartition(*KEYS).sortWithinPartitions(*KEYS), threshold), "vector-links"
    )

    counts = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    reached = roots(found.select(F.col("vec_id").alias("u"), F.col("root").alias("v")))
    of_group = (
        groups.select("label", "h1", "h2", "weight", "vec_id")
        .join(counts, "vec_id", "left")
        .join(reached.withColumnRenamed("u", "vec_id"), "vec_id", "left")
        .select(
            "label", "h1", "h2",
            (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
            F.coalesce("root", "vec_id").alias("component_id"),
        )
    )
    linked = usable.drop("embedding").join(of_group, ["label", "h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT usable").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
