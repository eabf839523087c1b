"""Byte-level BPE by backtracking over longest matches.

The tokens of a piece of text are the one way to cut it into tokens of which all
neighbours are compatible: merging the bytes of the two by rank must give exactly
these two. So instead of merging, the encoder walks from the left, takes the
longest token an Aho-Corasick automaton found there, and steps back to a shorter
one whenever neighbours do not fit. Fitting is memoised by pair, a place that led
nowhere is never tried twice, and a token has few prefixes in the vocabulary:
hence time linear in the length. Bytes stand as the Latin-1 characters of the
same numbers, since the automaton reads strings.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from satzwerk.llm.shared import per_text, portions

#: Entries of the memo of pieces and of pairs, after which a worker starts afresh.
MEMO = 1 << 19
#: Pieces longer than this are encoded without a place in the memo.
LONG_PIECE = 256
#: Stands for the rank of two tokens that no merge joins.
NEVER = 1 << 40


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file with a token in base64 and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merged(piece: bytes, ranks: dict[bytes, int], down_to: int = 1) -> list[bytes]:
    """The plain merges: join the neighbours of the lowest rank, leftmost first."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > down_to:
        rank, at = min(
            (ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))
        )
        if rank == NEVER:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class _Shorter(dict):
    """The next shorter token that a token begins with, or nothing."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks

    def __missing__(self, token: bytes) -> bytes:
        lengths = range(len(token) - 1, 0, -1)
        found = next((token[:n] for n in lengths if token[:n] in self.ranks), b"")
        self[token] = found
        return found


class _AfterSpace(dict):
    """The ids of a stretch of text with the space before it, found once."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder

    def __missing__(self, rest: str) -> bytes:
        ids = self.encoder.encode_run(" " + rest)
        if len(rest) <= LONG_PIECE:
            if len(self) >= MEMO:
                self.clear()
            self[rest] = ids
        return ids


class Encoder:
    """Encodes and decodes whole texts by the ranks of a vocabulary.

    All 256 single bytes must be tokens. Special tokens do not exist here: their
    strings are ordinary text. ``cut_at_spaces`` says that the pattern takes at
    most one space in front of other characters, as those of public byte-level
    vocabularies do; a pattern whose matches hold spaces inside needs it off.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, cut_at_spaces: bool = True):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("every single byte must be a token")
        self.ranks = ranks
        self.above = max(ranks.values()) + 2
        self.split = regex.compile(pattern).findall
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token in ranks:
            self.automaton.add_word(token.decode("latin-1"), len(token) - 1)
        self.automaton.make_automaton()
        self.last_merge: dict[bytes, tuple[bytes, bytes] | None] = {}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.pieces: dict[str, bytes] = {}
        self.shorter = _Shorter(ranks)
        self.after_space = _AfterSpace(self)
        self.cut_at_spaces = cut_at_spaces
        self.odd_space = re.compile(r" (?:\s|\Z)").search

    def halves(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The last merge that makes a token; None if merging never ends in it."""
        if token not in self.last_merge:
            parts = merged(token, self.ranks, down_to=2)
            made = len(parts) == 2 and self.ranks.get(parts[0] + parts[1]) is not None
            self.last_merge[token] = (parts[0], parts[1]) if made else None
        return self.last_merge[token]

    def fits(self, left: bytes, right: bytes) -> bool:
        """Whether the two tokens stay as they are next to each other."""
        pair = (left, right)
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) >= MEMO:
                self.pairs.clear()
            known = self.pairs[pair] = self.stays_apart(left, right)
        return known

    def stays_apart(self, left: bytes, right: bytes) -> bool:
        """Undo the merges of both sides, the latest first, down to single bytes.

        At each step the two parts that touch must not have merged before the
        merge just undone: strictly before one on the left, which comes first
        among equal ranks, and up to the same rank before one on the right.
        """
        ranks, limit = self.ranks, self.above
        if len(right) > 1 and self.halves(right) is None:
            return False
        if not left:
            return True
        while True:
            across = ranks.get(left + right)
            if across is not None and across < limit:
                return False
            if len(left) > 1 and (len(right) == 1 or ranks[left] > ranks[right]):
                limit, left = ranks[left], self.halves(left)[1]
            elif len(right) > 1:
                limit, right = ranks[right] + 1, self.halves(right)[0]
            else:
                return True

    def cut(self, piece: bytes) -> list[bytes]:
        """The tokens of one piece."""
        if piece in self.ranks:  # a piece that is a token is that token
            return [piece]
        size = len(piece)
        longest = [0] * (size + 1)  # where the longest token from each place ends
        for end, before in self.automaton.iter(piece.decode("latin-1")):
            longest[end - before] = end + 1  # ends rise, so the last is the longest
        pairs, shorter = self.pairs, self.shorter
        dead = bytearray(size + 1)
        cuts: list[bytes] = []
        left, at, end = b"", 0, longest[0]
        while at < size:
            token = piece[at:end]
            while token:
                if not dead[at + len(token)]:
                    fits = pairs.get((left, token))
                    if fits is None:
                        fits = self.fits(left, token)
                    if fits:
                        break
                token = shorter[token]
            if token:
                cuts.append(token)
                left = token
                at += len(token)
                end = longest[at]
            else:  # nothing leads on from here: step back, and go on with a shorter token
                dead[at] = 1
                end = at
                at -= len(cuts.pop())
                left = cuts[-1] if cuts else b""
        return cuts

    def encode_piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            tokens = self.cut(piece.encode("utf-8"))
            ids = np.array([self.ranks[token] for token in tokens], dtype="<u4").tobytes()
            if len(piece) <= LONG_PIECE:
                if len(self.pieces) >= MEMO:
                    self.pieces.clear()
                self.pieces[piece] = ids
        return ids

    def encode_run(self, text: str) -> bytes:
        return b"".join(map(self.encode_piece, self.split(text)))

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers.

        A text whose spaces stand alone is cut before each of them first: no match
        of the pattern reaches over such a space, so the cuts change nothing and
        the stretches between them repeat, which the memo makes use of.
        """
        if not self.cut_at_spaces or self.odd_space(text):
            return self.encode_run(text)
        first, *others = text.split(" ")
        return self.encode_run(first) + b"".join(map(self.after_space.__getitem__, others))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_ready: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """The encoder of a vocabulary file, built once in each Python worker."""
    key = (path, pattern)
    if key not in _ready:
        _ready[key] = Encoder(read_ranks(path), pattern)
    return _ready[key]


def with_ids(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Add the ids of each text as BINARY, 4 bytes an id.

    Each match of ``pattern`` is encoded on its own. NULL and empty texts have no
    ids. No shuffle: rows stay where they are and each is encoded whole.
    """

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = encoder(vocabulary, pattern).encode
        for texts in chain.from_iterable(map(portions, batches)):
            yield pa.array([encode(x or "") for x in texts.to_pylist()], pa.binary())

    return docs.withColumn(out, run(F.col(text)))


def with_text(encoded: DataFrame, vocabulary: str, pattern: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """Add the bytes that ids stand for; NULL stands for nothing."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decode = encoder(vocabulary, pattern).decode
        for rows in batches:
            yield rows.map(lambda x: decode(x) if x is not None else b"")

    return encoded.withColumn(out, run(F.col(ids)))


def encoded_digests(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Per document its number of ids and digests of its ids and of the decoded bytes.

    Encodes, decodes what was encoded, and keeps only the digests, so that ids do
    not travel. Equal rows give equal rows; columns other than doc_id and text
    are not looked at; an empty table gives an empty one.
    """

    def start() -> Callable[[str | None], tuple]:
        bpe = encoder(vocabulary, pattern)

        def digests(text: str | None) -> tuple:
            ids = bpe.encode(text or "")
            back = bpe.decode(ids)
            return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()

        return digests

    return per_text(docs, start, "n_tokens bigint, ids_sha256 string, decoded_sha256 string")
