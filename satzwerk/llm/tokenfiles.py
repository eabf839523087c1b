"""Token ids in files of patched frame-of-reference blocks.

A file holds a run of documents in ascending doc_id order, cut into pages; a page
holds whole documents. Its ids are cut into blocks of ``BLOCK``. Of each block the
minimum is taken off and the rest packed with the bits that ``PERCENTILE`` percent
of it need; what needs more goes into an exception list as place and high bits. An
index gives the byte where each block starts, so a document can be read without
what stands before it. Pages are rows of Parquet: Spark writes them, any store
holds them, and a lost task writes its file again.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

BLOCK = 128
PERCENTILE = 90
#: Ids after which a page ends with the document at hand.
PAGE_IDS = 1 << 17
#: Bytes of text that a file holds, roughly.
FILE_BYTES = 32 << 20
#: Files whose places in the whole (16 bytes each) are broadcast; more are joined.
MAX_BROADCAST = 1 << 20
#: Distinct stretches of text that a worker remembers the ids of.
MEMO = 1 << 20
#: Marks that end a token after a letter; the apostrophe is none of them.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

PAGE_TYPE = (
    "file_no int, page_no int, first_id bigint, n_docs bigint, n_ids bigint, doc_ids binary, null_ids binary, "
    "lengths binary, minima binary, widths binary, starts binary, packed binary, "
    "exception_counts binary, exception_places binary, exception_highs binary"
)


# --- blocks -----------------------------------------------------------------


def pack(ids: np.ndarray) -> dict[str, bytes]:
    """The blocks of an array of unsigned 32-bit ids; the last is filled with its first id."""
    count = -(-len(ids) // BLOCK)
    blocks = np.empty((count, BLOCK), dtype=np.uint32)
    flat = blocks.reshape(-1)
    flat[: len(ids)] = ids
    if count:
        flat[len(ids) :] = blocks[-1, 0]
    minima = blocks.min(axis=1, initial=2**32 - 1).astype("<u4")
    blocks -= minima[:, None]
    bits = np.frexp(blocks.astype(np.float64))[1].astype(np.uint8)  # the bits each number needs
    at = BLOCK * PERCENTILE // 100
    widths = np.partition(bits, at, axis=1)[:, at] if count else np.zeros(0, dtype=np.uint8)
    starts = np.concatenate([[0], np.cumsum(widths.astype(np.int64) * (BLOCK // 8))])
    packed = np.zeros(starts[-1], dtype=np.uint8)
    for width in np.unique(widths):
        rows = np.flatnonzero(widths == width)
        if width:
            places = starts[rows][:, None] + np.arange(int(width) * BLOCK // 8)
            packed[places] = _pack_bits(blocks[rows], int(width))
    low = (np.uint64(1) << widths.astype(np.uint64)) - np.uint64(1)
    high = blocks > low[:, None]
    block, place = np.nonzero(high)
    return {
        "minima": minima.tobytes(),
        "widths": widths.tobytes(),
        "starts": starts.astype("<u8").tobytes(),
        "packed": packed.tobytes(),
        "exception_counts": high.sum(axis=1).astype(np.uint8).tobytes(),
        "exception_places": place.astype(np.uint8).tobytes(),
        "exception_highs": (blocks[block, place] >> widths[block].astype(np.uint32)).astype("<u4").tobytes(),
    }


def _pack_bits(numbers: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bits of each number, lowest first, 8 to a byte."""
    if width % 8 == 0:
        whole = np.ascontiguousarray(numbers, dtype="<u4").view(np.uint8).reshape(len(numbers), BLOCK, 4)
        return whole[:, :, : width // 8].reshape(len(numbers), -1)
    shifts = np.arange(width, dtype=np.uint32)
    out = np.empty((len(numbers), BLOCK * width // 8), dtype=np.uint8)
    for i in range(0, len(numbers), 256):
        bits = (numbers[i : i + 256, :, None] >> shifts) & np.uint32(1)
        out[i : i + 256] = np.packbits(bits.astype(np.uint8).reshape(len(bits), -1), axis=1, bitorder="little")
    return out


def unpack(page: dict[str, bytes], n_ids: int) -> np.ndarray:
    """The ids of a page."""
    minima = np.frombuffer(page["minima"], dtype="<u4")
    widths = np.frombuffer(page["widths"], dtype=np.uint8)
    starts = np.frombuffer(page["starts"], dtype="<u8").astype(np.int64)
    packed = np.frombuffer(page["packed"], dtype=np.uint8)
    blocks = np.zeros((len(minima), BLOCK), dtype=np.uint32)
    for width in np.unique(widths):
        rows = np.flatnonzero(widths == width)
        if not width:
            continue
        if width % 8 == 0:
            places = starts[rows][:, None] + np.arange(int(width) * BLOCK // 8)
            whole = np.zeros((len(rows), BLOCK, 4), dtype=np.uint8)
            whole[:, :, : width // 8] = packed[places].reshape(len(rows), BLOCK, width // 8)
            blocks[rows] = whole.view("<u4")[:, :, 0]
            continue
        powers = np.uint32(1) << np.arange(width, dtype=np.uint32)
        for i in range(0, len(rows), 256):
            some = rows[i : i + 256]
            places = starts[some][:, None] + np.arange(int(width) * BLOCK // 8)
            bits = np.unpackbits(packed[places], axis=1, bitorder="little")
            blocks[some] = bits.reshape(len(some), BLOCK, int(width)).astype(np.uint32) @ powers
    counts = np.frombuffer(page["exception_counts"], dtype=np.uint8)
    block = np.repeat(np.arange(len(minima)), counts)
    place = np.frombuffer(page["exception_places"], dtype=np.uint8)
    highs = np.frombuffer(page["exception_highs"], dtype="<u4")
    blocks[block, place] |= highs << widths[block].astype(np.uint32)
    blocks += minima[:, None]
    return blocks.reshape(-1)[:n_ids]


def unpack_block(page: dict[str, bytes], number: int) -> np.ndarray:
    """One block of a page, found through the index of starts alone."""
    counts = np.frombuffer(page["exception_counts"], dtype=np.uint8)
    first, some = int(counts[:number].sum()), int(counts[number])
    start, end = np.frombuffer(page["starts"], dtype="<u8")[number : number + 2].astype(int)
    alone = {
        "minima": page["minima"][4 * number : 4 * number + 4],
        "widths": page["widths"][number : number + 1],
        "starts": np.array([0, end - start], dtype="<u8").tobytes(),
        "packed": page["packed"][start:end],
        "exception_counts": page["exception_counts"][number : number + 1],
        "exception_places": page["exception_places"][first : first + some],
        "exception_highs": page["exception_highs"][4 * first : 4 * (first + some)],
    }
    return unpack(alone, BLOCK)


# --- tokens -----------------------------------------------------------------


def _plain_end(core: str) -> bool:
    """Whether a stretch ends in a letter whose lower case ends in one too.

    Asked of letters up to the Latin ones with signs; all others count as none.
    """
    return "" < core[-1:] < "\u0250" and core[-1].isalpha() and core[-1].lower()[-1].isalpha()


def _bytes_of(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned numbers of 4 bytes."""
    few = array("I", ids)  # for a few numbers quicker than an array of numpy
    return few.tobytes() if few.itemsize == 4 and sys.byteorder == "little" else np.array(ids, dtype="<u4").tobytes()


class _Stretches(dict):
    """The ids of stretches between white space, each encoded once.

    Half the memo at a time grows old; what is met again before the next half is
    full is taken over, so frequent stretches stay.
    """

    def __init__(self, encode: Callable[[str], list[int]]):
        self.encode = encode
        self.old: dict[str, bytes] = {}

    def __missing__(self, stretch: str) -> bytes:
        ids = self.old.get(stretch)
        if ids is None:
            core = stretch if stretch[-1:].isalpha() else stretch.rstrip(MARKS)
            if core != stretch and _plain_end(core):  # a token never holds both
                ids = self[core] + self[stretch[len(core) :]]
            else:
                ids = _bytes_of(self.encode(stretch))
        if len(stretch) <= 256:
            if len(self) >= MEMO // 2:
                self.old = dict(self)
                self.clear()
            self[stretch] = ids
        return ids


#: Python's split takes these for white space; the vocabulary does not.
_separators = re.compile("[\x1c-\x1f]").search
_spaces = re.compile(r"[ \t\n\r\x0b\x0c]+").split


def stretches_of(text: str) -> list[str]:
    """The stretches between white space, in lower case where that is plain.

    Letters of Latin-1 have one lower-case form whatever stands around them, so
    texts of these alone are lowered at once; other texts are left to the library.
    """
    try:
        text.encode("latin-1")
        text = text.lower()
    except UnicodeEncodeError:
        pass
    return _spaces(text) if _separators(text) else text.split()


#: Lower-case letters whose form the normalizers below leave as it is.
_plain_word = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+").fullmatch
#: The signs by which byte-level vocabularies write bytes.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_SIGNS = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _SHOWN)}


def takes_words_whole(tokenizer) -> bool:
    """Whether a word of lower-case letters reaches the model of a vocabulary as one piece, by the signs of its bytes."""
    spec = json.loads(tokenizer.to_str())
    normalizers = (spec["normalizer"] or {}).get("normalizers", [])
    pieces = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    return (
        [n["type"] for n in normalizers] == ["NFC", "Replace", "Lowercase"]
        and normalizers[1]["pattern"] == {"Regex": r"\s+"}
        and [p["type"] for p in pieces] == ["Split", "ByteLevel"]
        and pieces[0]["pattern"] == {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
        and (pieces[0]["behavior"], pieces[0]["invert"]) == ("Removed", True)
        and not (pieces[1]["add_prefix_space"] or pieces[1]["use_regex"])
        and not (spec["truncation"] or spec["padding"] or spec["model"].get("dropout"))
    )


_ready: dict[tuple[str, bool], Callable[[str], bytes]] = {}


def word_tokenizer(path: str, by_stretch: bool = True) -> Callable[[str], bytes]:
    """Text to ids with a file of the tokenizers library, as its plain call without special tokens gives them.

    So a string of a special token in a text is that token, as in the library.
    ``by_stretch`` is for vocabularies of lower case that drop white space and never
    look across it: each stretch between white space is then encoded once and
    remembered, words of plain letters by the library's model alone. Texts that may
    hold a special token's string are left to the library.
    """
    key = (path, by_stretch)
    if key not in _ready:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        special = [token.content.lower() for token in tokenizer.get_added_tokens_decoder().values()]

        def encode(text: str) -> list[int]:
            return tokenizer.encode(text, add_special_tokens=False).ids

        model, whole = tokenizer.model, takes_words_whole(tokenizer)

        def encode_stretch(stretch: str) -> list[int]:
            if not (whole and _plain_word(stretch)):
                return encode(stretch)
            if not stretch.isascii():
                stretch = stretch.encode().decode("latin-1").translate(BYTE_SIGNS)
            return [token.id for token in model.tokenize(stretch)]

        stretches = _Stretches(encode_stretch)

        def ids_of(text: str) -> bytes:
            lowered = text.lower()
            if not by_stretch or any(token in lowered for token in special):
                return _bytes_of(encode(text))
            return b"".join(map(stretches.__getitem__, stretches_of(text)))

        _ready[key] = ids_of
    return _ready[key]


# --- files ------------------------------------------------------------------


def _page(file_no: int, page_no: int, first_id: int, doc_ids: list, ids: list[bytes]) -> dict:
    joined = np.frombuffer(b"".join(ids), dtype="<u4")
    numbers = np.array([0 if d is None else d for d in doc_ids], dtype="<i8")
    return {
        "file_no": file_no,
        "page_no": page_no,
        "first_id": first_id,
        "n_docs": len(doc_ids),
        "n_ids": len(joined),
        "doc_ids": numbers.tobytes(),
        "null_ids": np.array([d is None for d in doc_ids], dtype=np.uint8).tobytes(),
        "lengths": (np.array(list(map(len, ids)), dtype="<u8") // 4).tobytes(),
        **pack(joined),
    }


def _batch(pages: list[dict], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(pages, schema=arrow)


def write_ids(
    docs: DataFrame, path: str, vocabulary: str, end_id: int | None, by_stretch: bool = True,
    file_bytes: int = FILE_BYTES,
) -> None:
    """Encode every text and write the ids in ascending doc_id order.

    NULL doc_ids come first. ``end_id`` follows each document. NULL and empty
    texts have that id alone. Equal doc_ids stand next to each other, by their
    text. The texts are dealt out by ranges of doc_id once, encoded once, and
    never gathered in one place. Columns other than doc_id and text do not
    matter; an empty table gives files without pages.
    """
    end = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()
    schema = StructType.fromDDL(PAGE_TYPE)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_tokenizer(vocabulary, by_stretch)
        file_no, page_no, first_id, doc_ids, ids, held = TaskContext.get().partitionId(), 0, 0, [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(encode(text or "") + end)
                doc_ids.append(doc_id)
                held += len(ids[-1]) // 4
                if held >= PAGE_IDS:
                    yield _batch([_page(file_no, page_no, first_id, doc_ids, ids)], arrow)
                    page_no, first_id, doc_ids, ids, held = page_no + 1, first_id + held, [], [], 0
        if doc_ids:
            yield _batch([_page(file_no, page_no, first_id, doc_ids, ids)], arrow)

    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
        .repartitionByRange(1 + size // file_bytes, F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
        .mapInArrow(run, schema)
        .write.option("compression", "uncompressed")
        .parquet(path)
    )


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids (BINARY, 4 bytes each).

    ``start`` counts the ids of all documents before it. Only the page counts are
    summed up across files.
    """
    return _read(spark, path, "ids binary", lambda ids: (ids.tobytes(),))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_ids``, with ids_crc32 in place of the ids."""
    return _read(spark, path, "ids_crc32 bigint", lambda ids: (zlib.crc32(ids.tobytes()),))


def _read(spark: SparkSession, path: str, fields: str, made: Callable[[np.ndarray], tuple]) -> DataFrame:
    pages = spark.read.schema(PAGE_TYPE).parquet(path)
    last = pages.agg(F.max("file_no")).first()[0] or 0
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    files = (
        pages.groupBy("file_no")
        .agg(F.sum("n_ids").alias("_ids"))
        .select(F.col("file_no").alias("_file"), F.coalesce(F.sum("_ids").over(before), F.lit(0)).alias("_before"))
    )
    schema = StructType.fromDDL(f"doc_id bigint, start bigint, n_tokens bigint, {fields}")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                page = batch.slice(at, 1).to_pylist()[0]
                ids = unpack(page, page["n_ids"])
                lengths = np.frombuffer(page["lengths"], dtype="<u8").astype(np.int64)
                ends = np.cumsum(lengths)
                rows = [made(part) for part in np.split(ids, ends[:-1])]
                doc_ids = pa.array(
                    np.frombuffer(page["doc_ids"], dtype="<i8"),
                    mask=np.frombuffer(page["null_ids"], dtype=np.uint8).astype(bool),
                )
                arrays = [doc_ids, pa.array(page["start"] + ends - lengths), pa.array(lengths)]
                arrays += [pa.array(c, f.type) for c, f in zip(zip(*rows), list(arrow)[3:], strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    if last < MAX_BROADCAST:
        files = F.broadcast(files)
    placed = pages.join(files, F.col("file_no") == F.col("_file"))
    return placed.withColumn("start", F.col("_before") + F.col("first_id")).drop("_file", "_before").mapInArrow(run, schema)
