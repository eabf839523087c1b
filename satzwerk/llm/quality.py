"""Quality rules: compression bands.

Prose compresses within a narrow band that depends on its length. Text below the
band repeats itself (templates, lists of fillers, copied lines); text above it is
noise (keys, encoded data). The ratio of compressed to plain bytes by zstandard is
taken of the whole text and of chunks of ``CHUNK`` bytes, so that a bad stretch
within a long text shows as well. Plain counts of words, symbols, doubled
lines and repeated windows stand beside it.

The limits are those of about one byte a letter. So letters of other alphabets are
one byte each (``as_letters``) before the text is compressed, and a text has the
same verdict in whatever alphabet it is spelled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from satzwerk.llm.shared import per_text, portions

LEVEL = 3
#: Limits of the ratio at lengths in bytes; between them, by the logarithm of the length.
#: Fitted close outside what is labelled good; from 64 KB on by prose resampled from it,
#: as zstandard gains up to its window of 2 MB.
LENGTHS = (128, 192, 256, 384, 512, 768, 1024, 1536, 2048, 4096, 8192, 16384, 32768, 131072, 1 << 20, 1 << 22)
LOWEST = (0.72, 0.645, 0.605, 0.543, 0.516, 0.507, 0.494, 0.47, 0.455, 0.4375, 0.4155, 0.395, 0.38, 0.37, 0.352, 0.345)
HIGHEST = (0.95, 0.89, 0.84, 0.77, 0.74, 0.68, 0.64, 0.60, 0.58, 0.56, *(0.54,) * 6)
#: Sizes of chunks with the limits for each; the largest that a text fills is taken.
CHUNK_BANDS = {512: (0.505, 0.74), 1024: (0.487, 0.63), 2048: (0.456, 0.57)}

MIN_WORDS = 20
WINDOW = 8
MOST_REPEATED = 30  # percent of words within repeated windows

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
#: Code points beyond Latin letters, marks and signs.
OTHER_LETTERS = ((0x370, 0x1DFF), (0x1F00, 0x1FFF), (0x2C00, 0x10FFFF))
#: Signs of an alphabet lie within so many code points.
ALPHABET = 128

_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(WINDOW)], dtype=np.uint64)


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of eight that occur twice or more in the text."""
    count = len(words) - WINDOW + 1
    if count < 2:
        return 0
    hashed = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).astype(np.uint64)
    windows = np.zeros(count, dtype=np.uint64)
    for k in range(WINDOW):
        windows += hashed[k : k + count] * _POWERS[k]
    ordered = np.sort(windows)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return 0
    starts = np.flatnonzero(np.isin(windows, again))
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    edges[starts] += 1
    np.subtract.at(edges, starts + WINDOW, 1)
    return int((np.cumsum(edges) > 0).sum())


def as_letters(text: str, data: bytes) -> bytes:
    """The text as ``data`` (UTF-8), but each letter of another alphabet as one byte.

    The byte is 128 and the code point modulo 128. A text of more such signs than
    an alphabet has (Chinese, Korean) stays as it is.
    """
    if len(data) == len(text):
        return data
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    other = np.zeros(len(points), dtype=bool)
    for low, high in OTHER_LETTERS:
        other |= (points >= low) & (points <= high)
    if not 0 < len(np.unique(points[other])) <= ALPHABET:
        return data
    # U+DC80 to U+DCFF stand for the bytes 128 to 255.
    points = np.where(other, np.uint32(0xDC80) | points & np.uint32(ALPHABET - 1), points).astype("<u4")
    return points.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogateescape")


class Bands:
    """The verdict by compression; one compressor for all texts of a worker."""

    def __init__(self):
        self.compressor = zstandard.ZstdCompressor(
            level=LEVEL, write_checksum=False, write_content_size=False
        )
        self.at = np.log2(LENGTHS)

    def ratio(self, data: bytes) -> float:
        return len(self.compressor.compress(data)) / len(data)

    def look(self, data: bytes) -> tuple[float, float, float, bool]:
        """Ratio of the whole, lowest and highest of the chunks, and whether all are inside.

        A text without a full chunk has the ratio of the whole there; an empty one
        has 1 everywhere and is outside.
        """
        if not data:
            return 1.0, 1.0, 1.0, False
        whole = self.ratio(data)
        size = np.log2(len(data))
        inside = np.interp(size, self.at, LOWEST) <= whole <= np.interp(size, self.at, HIGHEST)
        chunk = max((c for c in CHUNK_BANDS if c <= len(data)), default=0)
        chunks = []
        if chunk:
            starts = [*range(0, len(data) - chunk, chunk), len(data) - chunk]
            chunks = [self.ratio(data[i : i + chunk]) for i in starts]
            inside = inside and CHUNK_BANDS[chunk][0] <= min(chunks) and max(chunks) <= CHUNK_BANDS[chunk][1]
        return whole, min(chunks, default=whole), max(chunks, default=whole), bool(inside)


def measure(text: str | None, bands: Bands) -> tuple:
    """All counts and verdicts of one text; see ``VERDICT_TYPE`` for their order."""
    data = text.encode("utf-8") if isinstance(text, str) else b""
    words = data.split()  # bytes split at ASCII white space alone
    word_chars = len(text) - (len(data) - len(data.translate(None, SPACE))) if data else 0
    n_symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [line for line in data.split(b"\n") if line.strip(SPACE)]
    repeated = repeated_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeated > MOST_REPEATED * len(words)
    whole, lowest, highest, inside = bands.look(as_letters(text, data) if data else data)
    return (
        len(words), word_chars, n_symbols, len(lines) - len(set(lines)), repeated,
        failed, inside and not failed, whole, lowest, highest,
    )


VERDICT_TYPE = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, kept boolean, ratio double, lowest_chunk double, highest_chunk double"
)
KEPT = 6  # its place there


def judge(docs: DataFrame) -> DataFrame:
    """Counts and verdict per document: doc_id and the columns of ``VERDICT_TYPE``.

    NULL and empty texts have no words and fail. Every row is judged on its own,
    equal rows alike. Columns other than doc_id and text are not looked at. No
    shuffle; an empty table gives an empty one.
    """

    return per_text(docs, lambda: partial(measure, bands=Bands()), VERDICT_TYPE)


def keep(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns as they are."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands()
        for batch in chain.from_iterable(map(portions, batches)):
            texts = batch.column("text").to_pylist()
            yield batch.filter(pa.array([measure(text, bands)[KEPT] for text in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
