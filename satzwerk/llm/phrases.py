"""Collocations: phrases counted by broadcast double-array tries of candidates.

Texts are lower-cased (A-Z), split at punctuation and line ends into pieces and
those at blanks into words; all is counted per lang.

1. Blocks of texts become arrays of word numbers. A block asks for the numbers of
   its distinct words through one exchange, and only words said ``least`` times
   get one; all others, and the ends of pieces, are 0.
2. A phrase of n words is a candidate if both phrases of n - 1 words in it are
   frequent (Apriori) and if its bucket is: all candidates are first counted in
   saturating buckets (Park, Chen and Yu 1995), one for two occurrences of frequent
   words. Neither test can lose a frequent phrase. Where the text would need more
   than ``1 << MOST_BITS`` buckets, they only sieve less. What is left meets in shares
   of the buckets with how often each task has it, and only what is said ``least``
   times stays, so the tries do not grow with what the buckets let through.
3. Candidates go into double-array tries (Aoe 1989) over the bytes of their word
   numbers, at most ``PORTION`` in one, and are broadcast one trie after the other.
   They are in the order of their words, so a position is walked in the trie of its
   first word alone. Numpy moves the states of all positions of a block on together, byte by byte,
   drops the positions that have left the trie, and counts the accepting states
   by ``bincount``; the counts of all tasks are summed.

Only buckets (a bit each, 16 MB at most) and one trie pass through the driver at a time.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from satzwerk.llm.shared import forget, saved

BLOCK_BYTES = 8 << 20
#: Langs of which a task holds an open block.
LANGS = 16
#: A long text is split into words in stretches of about this size.
STRETCH = 1 << 20
LEAST_BITS, MOST_BITS = 16, 27
SLICE = 1 << 16
#: Distinct candidates that a task holds before it sends them.
HELD = 1 << 21
#: Candidates in one trie: some 100 MB with all its nodes.
PORTION = 1 << 20

_MARKS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b"..........\x20")
BLOCK_TYPE = "block bigint, lang string, word string, code int, n bigint, codes binary"
IDS_TYPE = "block bigint, lang string, ids binary, states binary"


def _pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def _unpack(data: bytes | None, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data) if data else b"", dtype=kind)


def words_of(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text in stretches, with ``.`` at each end of a piece."""
    data = (text or "").encode("utf-8").lower().translate(_MARKS)
    at = 0
    while at < len(data):
        cut = data.find(b" ", at + STRETCH) if len(data) - at > STRETCH else -1
        end = len(data) if cut < 0 else cut
        yield data[at:end].replace(b".", b" . ").split(b" ")
        at = end


# --- blocks of word numbers -------------------------------------------------


def pack_blocks(docs: DataFrame) -> DataFrame:
    """One row with the codes of each block, and one for each distinct word in it."""
    arrow = to_arrow_schema(StructType.fromDDL(BLOCK_TYPE))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, {}

        def close(lang: str) -> pa.RecordBatch:
            nonlocal number
            vocabulary, codes, _ = held.pop(lang)
            codes = np.frombuffer(codes, dtype=np.int32)
            counts = np.bincount(codes, minlength=len(vocabulary))[1:]
            words = [word.decode("utf-8") for word in vocabulary][1:]
            n = len(words)
            number += 1
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([number] * (n + 1), pa.int64()),
                    pa.array([lang] * (n + 1), pa.string()),
                    pa.array([*words, None], pa.string()),
                    pa.array([*range(1, n + 1), None], pa.int32()),
                    pa.array([*counts.tolist(), None], pa.int64()),
                    pa.array([None] * n + [_pack(codes)], pa.binary()),
                ],
                schema=arrow,
            )

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                block = held.setdefault(lang, [{b".": 0}, array("i"), 0])
                vocabulary, codes, _ = block
                for words in words_of(text):
                    codes.extend([vocabulary.setdefault(word, len(vocabulary)) for word in words if word])
                codes.append(0)
                block[2] += len(text or "")
                if block[2] >= BLOCK_BYTES:
                    yield close(lang)
                elif len(held) > LANGS:
                    yield close(max(held, key=lambda other: held[other][2]))
        for lang in list(held):
            yield close(lang)

    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")), "text").mapInArrow(run, BLOCK_TYPE)


def numbered(frame: DataFrame, name: str, first: int = 1) -> DataFrame:
    """The rows as a saved table with ``id``: whole numbers without a gap.

    The number of rows in each partition, one number a partition, comes to the driver.
    """
    at = F.monotonically_increasing_id()
    frame = saved(frame.select("*", F.shiftright(at, 33).cast("int").alias("_part"), (at % (1 << 33)).alias("_at")), name)
    start, starts = first, []
    for part, n in sorted(map(tuple, frame.groupBy("_part").count().collect())):
        starts.append((part, start))
        start += n
    offsets = frame.sparkSession.createDataFrame(starts, "_part int, _start bigint")
    joined = frame.join(F.broadcast(offsets), "_part")
    return joined.select(*(c for c in frame.columns if c not in ("_part", "_at")), (F.col("_start") + F.col("_at")).alias("id"))


def number_words(blocks: DataFrame, frequent: DataFrame) -> DataFrame:
    """The blocks with the numbers of frequent words (lang, word, id) in place of codes; 0 for all else."""
    arrow = to_arrow_schema(StructType.fromDDL(IDS_TYPE))
    replies = blocks.where("codes IS NULL").join(frequent, ["lang", "word"]).select(F.col("block").alias("asking"), "code", "id")

    def receive(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for block, lang, data in zip(*(left[c].to_pylist() for c in ("block", "lang", "codes")), strict=True):
            codes = _unpack(data, "<i4")
            table = np.zeros(int(codes.max(initial=0)) + 1, dtype=np.int32)
            table[right["code"].to_numpy()] = right["id"].to_numpy()
            ids = table[codes]
            keep = ids > 0
            keep[1:] |= ids[:-1] > 0  # of neighbouring zeros the first
            rows.append({"block": block, "lang": lang, "ids": _pack(ids[keep]), "states": None})
        return pa.Table.from_pylist(rows, schema=arrow)

    whole = blocks.where("codes IS NOT NULL").select("block", "lang", "codes")
    return whole.groupBy("block").cogroup(replies.groupBy("asking")).applyInArrow(receive, IDS_TYPE)


# --- double-array tries -----------------------------------------------------


def _rows(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its count."""
    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


class Trie:
    """A double array over the bytes of numbers: ``check[base[state] + byte] == state``."""

    def __init__(self, phrases: np.ndarray):
        """``phrases``: distinct rows of numbers above 0; the state of row n accepts n."""
        self.digits = max(1, (int(phrases.max(initial=0)).bit_length() + 7) // 8)
        self.words = phrases.shape[1]
        self.first, self.last = int(phrases[:, 0].min(initial=np.iinfo(np.int32).max)), int(phrases[:, 0].max(initial=0))
        size = 8192 + 2 * len(phrases)
        self.base, self.check = np.zeros(size, dtype=np.int32), np.full(size, -1, dtype=np.int32)
        self._low, self._top = 256, 256  # where gaps are looked for, and where all is empty
        self.check[0] = -2  # the root's own place
        state = np.zeros(len(phrases), dtype=np.int32)
        for k in range(self.words):
            for digit in range(self.digits)[::-1]:
                edges = state.astype(np.int64) << 8 | phrases[:, k] >> (8 * digit) & 255
                edges, of_row = np.unique(edges, return_inverse=True)
                of_row = of_row.astype(np.int32)
                state = self._place((edges >> 8).astype(np.int32), (edges & 255).astype(np.int32))[of_row]
                del edges, of_row
        end = self._top + 256
        self._fit(end)
        self.base, self.check = self.base[:end], self.check[:end]
        self.accept = np.full(end, -1, dtype=np.int32)
        self.accept[state] = np.arange(len(phrases))

    def _fit(self, size: int) -> None:
        if size > len(self.base):
            more = max(size, len(self.base) * 5 // 4) - len(self.base)
            self.base = np.concatenate([self.base, np.zeros(more, dtype=np.int32)])
            self.check = np.concatenate([self.check, np.full(more, -1, dtype=np.int32)])

    def _place(self, parents: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Free slots for the children (parents ascending) of one level.

        Large nodes go into empty space; smaller ones try free places at random, all
        at once, until each has found one; single children fill what is left.
        """
        starts = np.flatnonzero(np.r_[True, parents[1:] != parents[:-1]]) if len(parents) else np.zeros(0, dtype=np.int64)
        counts = np.diff(np.r_[starts, len(parents)])
        offset = symbols - np.repeat(symbols[starts], counts)
        slots = np.zeros(len(parents), dtype=np.int32)

        def settle(nodes: np.ndarray, at: np.ndarray) -> None:
            rows = _rows(starts[nodes], counts[nodes])
            slots[rows] = np.repeat(at, counts[nodes]) + offset[rows]
            self.check[slots[rows]] = parents[rows]
            self.base[parents[starts[nodes]]] = at - symbols[starts[nodes]]
            self._top = max(self._top, int(slots[rows].max(initial=0)) + 1)

        large = np.flatnonzero(counts > 32)
        self._fit(self._top + 256 * len(large) + 8192)
        settle(large, self._top + 256 * np.arange(len(large)))
        left, chosen = np.flatnonzero((counts > 1) & (counts <= 32)), np.random.default_rng(0)
        while len(left):
            rows = _rows(starts[left], counts[left])
            end = max(self._top, self._low + 4 * len(rows)) + 1024
            self._fit(end + 8192)
            free = np.flatnonzero(self.check[self._low : end] == -1).astype(np.int32)
            at = self._low + free[chosen.integers(0, len(free), len(left))]
            del free
            wanted = np.repeat(at, counts[left]) + offset[rows]
            first = np.zeros(len(rows), dtype=bool)
            first[np.unique(wanted, return_index=True)[1]] = True
            heads = np.cumsum(counts[left]) - counts[left]
            won = np.logical_and.reduceat(first & (self.check[wanted] == -1), heads)
            settle(left[won], at[won])
            if won.mean() < 0.1:
                self._low = end  # dense: go on in empty space
            left = left[~won]
        single = starts[counts == 1]
        self._fit(self._top + len(single) + 8192)
        free = np.flatnonzero(self.check[256:] == -1)[: len(single)] + 256
        settle(np.flatnonzero(counts == 1), free)
        self._fit(self._top + 4096)
        return slots

    def walk(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The positions at which a phrase starts, and the number of that phrase."""
        n = len(ids) - self.words + 1
        if n <= 0 or not len(self.accept):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)
        at = np.flatnonzero((ids[:n] >= self.first) & (ids[:n] <= self.last))
        for k in range(1, self.words):
            at = at[ids[at + k] > 0]
        state = np.zeros(len(at), dtype=np.int32)
        for k in range(self.words):
            for digit in range(self.digits)[::-1]:
                symbol = (ids[at + k] >> (8 * digit)) & 255
                if digit == self.digits - 1 and k:
                    symbol = ids[at + k] >> (8 * digit)  # a larger number leaves the trie
                    inside = symbol < 256
                    at, state, symbol = at[inside], state[inside], symbol[inside]
                new = self.base[state] + symbol
                on = self.check[new] == state
                at, state = at[on], new[on]
        found = self.accept[state]
        return at[found >= 0], found[found >= 0]


# --- one level --------------------------------------------------------------


def _pairs(ids: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where two frequent phrases start side by side, and their numbers; before the first trie the words themselves."""
    s = states if len(states) else ids
    both = np.flatnonzero((s[:-1] > 0) & (s[1:] > 0)) if len(s) > 1 else np.zeros(0, dtype=np.int64)
    return both, s[both].astype(np.int64), s[both + 1].astype(np.int64)


def bits_for(occurrences: int) -> int:
    return min(max((occurrences // 2).bit_length(), LEAST_BITS), MOST_BITS)


def _bucket(left: np.ndarray, right: np.ndarray, bits: int) -> np.ndarray:
    mixed = (left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, str, np.ndarray, np.ndarray]]:
    for batch in batches:
        for block, lang, ids, states in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield block, lang, _unpack(ids, "<i4"), _unpack(states, "<i4")


def full_buckets(blocks: DataFrame, bits: int, least: int) -> np.ndarray:
    """A bit for each bucket: whether ``least`` candidates or more (255 count as any more) fall into it."""
    least = min(least, 255)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = np.zeros(1 << bits, dtype=np.uint8)
        for *_, ids, states in _blocks(batches):
            buckets, counts = np.unique(_bucket(*_pairs(ids, states)[1:], bits), return_counts=True)
            full[buckets] = np.minimum(full[buckets] + counts, least)
        for start in range(0, len(full), SLICE):
            part = full[start : start + SLICE]
            if part.any():
                yield pa.RecordBatch.from_pylist([{"slice": start // SLICE, "counts": _pack(part)}])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {}
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held = sums.setdefault(number, np.zeros(SLICE, dtype=np.uint8))
                np.minimum(held + _unpack(data, "u1").astype(np.int64), least, out=held, casting="unsafe")
        for number, held in sums.items():
            yield pa.RecordBatch.from_pylist([{"slice": number, "counts": np.packbits(held >= least).tobytes()}])

    kind = "slice int, counts binary"
    schema = to_arrow_schema(StructType.fromDDL(kind))
    cast = lambda run: lambda batches: (b.cast(schema) for b in run(batches))
    sums = blocks.mapInArrow(cast(count), kind).repartition("slice").mapInArrow(cast(add), kind)
    full = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for number, part in sums.collect():
        full[number * SLICE // 8 : (number + 1) * SLICE // 8] = np.frombuffer(part, dtype=np.uint8)
    return full


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the sums of their counts."""
    together = np.concatenate([np.zeros(0, dtype=np.int64), *keys])
    order = np.argsort(together)
    together = together[order]
    starts = np.flatnonzero(np.r_[True, together[1:] != together[:-1]]) if len(together) else order
    sums = np.add.reduceat(np.concatenate(counts)[order], starts) if len(starts) else starts
    return together[starts], sums


def candidates(blocks: DataFrame, words: list[str], bits: int, least: int, parts: DataFrame | None = None) -> DataFrame:
    """The phrases said ``least`` times or more of which both parts are frequent, as numbers of words.

    A task sends what falls into full buckets, as sorted, compressed arrays with its
    counts, one for each share of the buckets; each share is summed up in one place.
    ``parts`` has the words of the parts, by ``id``; without it they are words themselves.
    """
    spark = blocks.sparkSession
    sieve = spark.sparkContext.broadcast(full_buckets(blocks, bits, least))
    shares = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent_type, found_type = "share int, keys binary, counts binary", "left int, right int"
    sent, found = (to_arrow_schema(StructType.fromDDL(t)) for t in (sent_type, found_type))

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full, held, more = sieve.value, [], 0

        def send(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            share = _bucket(keys >> 32, keys & 0xFFFFFFFF, bits) % shares
            order = np.argsort(share, kind="stable")
            keys, counts, cuts = keys[order], counts[order], np.searchsorted(share[order], np.arange(shares + 1))
            rows = [
                (n, _pack(np.diff(keys[cuts[n] : cuts[n + 1]], prepend=0)), _pack(counts[cuts[n] : cuts[n + 1]]))
                for n in range(shares) if cuts[n] < cuts[n + 1]
            ]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), sent, strict=True)], schema=sent)

        for *_, ids, states in _blocks(batches):
            _, left, right = _pairs(ids, states)
            bucket = _bucket(left, right, bits)
            on = (full[bucket >> 3] >> (7 - (bucket & 7)) & 1) > 0
            held.append(np.unique(left[on] << 32 | right[on], return_counts=True))
            more += len(held[-1][0])
            if more > HELD:
                held = [_summed(*zip(*held))]
                more = 0
                if len(held[0][0]) > HELD:
                    yield send(*held.pop())
        if held and len((rest := _summed(*zip(*held)))[0]):
            yield send(*rest)

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for share, keys, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                got = held.setdefault(share, [])
                got.append((np.cumsum(_unpack(keys, "<i8")), _unpack(counts, "<i8")))
                if sum(len(keys) for keys, _ in got[1:]) > max(HELD, len(got[0][0])):  # what came since is more than what is merged
                    got[:] = [_summed(*zip(*got))]
        for got in held.values():
            keys, counts = _summed(*zip(*got))
            keys = keys[counts >= least]
            columns = [pa.array((keys >> 32).astype(np.int32)), pa.array((keys & 0xFFFFFFFF).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, schema=found)

    pairs = blocks.mapInArrow(find, sent_type).repartition(shares, "share").mapInArrow(join, found_type)
    if parts is None:
        return pairs.toDF(*words)
    first = parts.select(F.col("id").cast("int").alias("left"), *words[:-1])
    last = parts.select(F.col("id").cast("int").alias("right"), F.col(words[-2]).alias(words[-1]))
    return pairs.join(first, "left").join(last, "right").select(*words)


def _phrase_rows(phrases: DataFrame, words: list[str], start: int, size: int) -> np.ndarray:
    rows = phrases.where(F.col("id").between(start + 1, start + size)).orderBy("id").select(*words).toArrow()
    found = np.empty((rows.num_rows, len(words)), dtype=np.int32)
    for k, word in enumerate(words):
        found[:, k] = rows[word].to_numpy()
    return found


def portions(phrases: DataFrame, words: list[str], size: int) -> Iterator[tuple[int, Broadcast]]:
    """The phrases, numbered from 1, as tries of at most ``size`` that all tasks see, with the number before the first.

    A trie is destroyed when the next is asked for, and the driver keeps none.
    """
    n = phrases.agg(F.max("id")).first()[0] or 0
    for start in range(0, n, size):
        sent = phrases.sparkSession.sparkContext.broadcast(Trie(_phrase_rows(phrases, words, start, size)))
        yield start, sent
        sent.destroy()


def count_phrases(blocks: DataFrame, phrases: DataFrame, words: list[str], size: int, least: int = 1) -> DataFrame:
    """(id, f): how often each phrase stands in the blocks, if ``least`` times or more.

    A task sends its counts as compressed arrays, one for each ``SLICE`` numbers.
    """
    spark, counted = blocks.sparkSession, None
    sent_type, sum_type = "slice int, counts binary", "id bigint, f bigint"
    slices, found = (to_arrow_schema(StructType.fromDDL(t)) for t in (sent_type, sum_type))
    for start, sent in portions(phrases, words, size):

        def run(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(size, dtype="<i8")
            for *_, ids, _ in _blocks(batches):
                counts = np.bincount(sent.value.walk(ids)[1])
                sums[: len(counts)] += counts
            for at in range(0, size, SLICE):
                part = sums[at : at + SLICE]
                if part.any():
                    yield pa.RecordBatch.from_pylist([{"slice": at // SLICE, "counts": _pack(part)}], schema=slices)

        def add(batches: Iterable[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for number, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    part = _unpack(data, "<i8")
                    sums[number] = sums[number] + part if number in sums else part
            for number, held in sums.items():
                some = np.flatnonzero(held >= least)
                columns = [pa.array(some + (start + number * SLICE + 1), pa.int64()), pa.array(held[some], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, schema=found)

        part = saved(blocks.mapInArrow(run, sent_type).repartition("slice").mapInArrow(add, sum_type), "phrase-counts")
        counted = part if counted is None else counted.unionByName(part)
    return spark.createDataFrame([], sum_type) if counted is None else counted


def with_states(blocks: DataFrame, phrases: DataFrame, words: list[str], size: int) -> DataFrame:
    """The blocks with, at each position, the number of the phrase that starts there, or 0."""
    arrow, some = to_arrow_schema(StructType.fromDDL(IDS_TYPE)), False
    for start, sent in portions(phrases, words, size):
        old = blocks

        def run(batches: Iterable[pa.RecordBatch], sent=sent, start=start) -> Iterator[pa.RecordBatch]:
            for block, lang, ids, states in _blocks(batches):
                states = states.copy() if len(states) else np.zeros(len(ids), dtype=np.int32)
                at, found = sent.value.walk(ids)
                states[at] = found + start + 1
                yield pa.RecordBatch.from_pylist([{"block": block, "lang": lang, "ids": _pack(ids), "states": _pack(states)}], schema=arrow)

        blocks = saved(old.mapInArrow(run, IDS_TYPE), "phrase-states")
        if some:
            forget(old)
        some = True
    return blocks if some else blocks.where("false")


# --- the operator -----------------------------------------------------------


def counted_phrases(docs: DataFrame, least: int, size: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Words in all (lang, n), and what is said ``least`` times: words, pairs, triples with f.

    Words have lang, word, id; pairs w1, w2; triples w1, w2, w3.
    """
    blocks = saved(pack_blocks(docs), "phrase-blocks")
    said = blocks.where("codes IS NULL")
    totals = saved(said.groupBy("lang").agg(F.sum("n").alias("n")), "phrase-totals")
    words = said.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    words = numbered(words, "phrase-words")
    ids = saved(number_words(blocks, words.select("lang", "word", "id")), "phrase-ids")
    forget(blocks)
    bits = bits_for(words.agg(F.sum("f")).first()[0] or 0)

    def frequent(states: DataFrame, spread: list[str], parts: DataFrame | None = None) -> DataFrame:
        found = saved(candidates(states, spread, bits, least, parts), "phrase-candidates")
        asked = numbered(found.repartitionByRange(*spread).sortWithinPartitions(*spread), "phrase-candidates")
        found = asked.join(count_phrases(ids, asked, spread, size, least), "id")
        return numbered(found.repartitionByRange("id").sortWithinPartitions("id").drop("id"), "phrases")

    pairs = frequent(ids, ["w1", "w2"])
    states = with_states(ids, pairs, ["w1", "w2"], size)
    triples = frequent(states, ["w1", "w2", "w3"], pairs)
    forget(states)
    return totals, words, pairs, triples


def collocations(docs: DataFrame, least: int = 10, first: int = 2000, size: int = PORTION) -> DataFrame:
    """The ``first`` phrases of two or three words of each lang that hold together best.

    A phrase said ``a >= least`` times is cut behind its k-th word: ``l`` and ``r``
    tell how often the two parts are said, and the score is 1,000,000 a a / (l r),
    rounded down; the cut of the lowest score counts, of equal ones the first. A
    phrase goes if a longer one said half as often or more holds it. Products may
    pass 64 bits and are decimals of 38 digits, exact up to 5 * 10^15 occurrences.

    Columns: lang, rank, phrase, a, l, r, n, score. A NULL lang counts as ``und``,
    a NULL text as empty. Repeated rows count as often as they are there; doc_id
    and other columns do not matter. Ties of score and a go by the bytes of the
    phrase. An empty table gives an empty one; a lang without a phrase has no row.
    """
    totals, words, pairs, triples = counted_phrases(docs, least, size)
    word = {k: words.select(F.col("id").alias(f"w{k}"), F.col("word").alias(f"t{k}"), F.col("f").alias(f"f{k}")) for k in (1, 2, 3)}
    langs = words.select(F.col("id").alias("w1"), "lang")
    first_two = pairs.select("w1", "w2", F.col("id").alias("p"), F.col("f").alias("f_p"))
    last_two = pairs.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("id").alias("q"), F.col("f").alias("f_q"))
    triples = saved(triples.drop("id").join(first_two, ["w1", "w2"]).join(last_two, ["w2", "w3"]), "phrase-triples")

    def score(a: str, l: str, r: str) -> str:  # noqa: E741
        wide = "CAST({} AS DECIMAL(16, 0))"
        return f"(1000000 * {wide.format(a)} * {wide.format(a)}) DIV ({wide.format(l)} * {wide.format(r)})"

    longer = triples.select(F.explode(F.array("p", "q")).alias("id"), F.col("f").alias("longer"))
    longer = longer.groupBy("id").agg(F.max("longer").alias("longer"))
    two = (
        pairs.join(longer, "id", "left").where("longer IS NULL OR 100 * longer < 50 * f")
        .join(word[1], "w1").join(word[2], "w2").join(langs, "w1")
        .select("lang", F.concat_ws(" ", "t1", "t2").alias("phrase"), F.col("f").alias("a"), F.col("f1").alias("l"), F.col("f2").alias("r"))
        .withColumn("score", F.expr(score("a", "l", "r")))
    )
    three = (
        triples.join(word[1], "w1").join(word[2].drop("f2"), "w2").join(word[3], "w3").join(langs, "w1")
        .withColumn("s1", F.expr(score("f", "f1", "f_q"))).withColumn("s2", F.expr(score("f", "f_p", "f3")))
        .select(
            "lang", F.concat_ws(" ", "t1", "t2", "t3").alias("phrase"), F.col("f").alias("a"),
            F.expr("IF(s1 <= s2, f1, f_p)").alias("l"), F.expr("IF(s1 <= s2, f_q, f3)").alias("r"), F.least("s1", "s2").alias("score"),
        )
    )
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    best = two.unionByName(three).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
