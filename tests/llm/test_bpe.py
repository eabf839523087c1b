import hashlib
import random

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from satzwerk.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def pair():
    ranks = bpe.read_ranks(PATH)
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return bpe.Encoder(ranks, public_tokenizers.PATTERN), known


def test_random_strings_encode_as_the_library_does(pair):
    mine, known = pair
    chosen = random.Random(1)
    for _ in range(4000):
        text = "".join(chosen.choices("abcdest AE'é́日z1_ \n\t\x1c\x85　\U0001f600", k=chosen.randint(0, 30)))
        ids = np.frombuffer(mine.encode(text), dtype="<u4").tolist()
        assert ids == known.encode_ordinary(text)
        assert mine.decode(mine.encode(text)) == text.encode()


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 3000, "<|endoftext|>", " " * 500, "\n \n  x", "日本語" * 700])
def test_hard_strings(pair, text):
    mine, known = pair
    assert np.frombuffer(mine.encode(text), dtype="<u4").tolist() == known.encode_ordinary(text)


def test_small_vocabularies_with_dead_ends():
    chosen = random.Random(5)
    for _ in range(60):
        ranks = {bytes([b]): b for b in range(256)}
        while len(ranks) < 256 + chosen.randint(1, 25):
            a, b = chosen.choice(list(ranks)[97:100] + list(ranks)[256:]), chosen.choice(list(ranks)[97:100] + list(ranks)[256:])
            if a + b not in ranks and len(a + b) < 9:
                ranks[a + b] = len(ranks)
        mine = bpe.Encoder(ranks, r"\S+|\s+")
        for _ in range(30):
            piece = bytes(chosen.choices(b"abc", k=chosen.randint(1, 25)))
            if piece not in ranks:
                assert mine.cut(piece) == bpe.merged(piece, ranks)


def test_whole_table(docs, rows, empty, pair):
    _, known = pair
    found = sorted(map(tuple, bpe.encoded_digests(docs, PATH, public_tokenizers.PATTERN).collect()), key=repr)
    want = []
    for doc_id, text, *_ in rows:
        ids = np.array(known.encode_ordinary(text or ""), dtype="<u4").tobytes()
        want.append((doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert found == sorted(want, key=repr)
    assert bpe.encoded_digests(empty, PATH, public_tokenizers.PATTERN).collect() == []


def test_columns_of_ids_and_back(docs):
    encoded = bpe.with_ids(docs.select("doc_id", "text"), PATH, public_tokenizers.PATTERN)
    back = bpe.with_text(encoded, PATH, public_tokenizers.PATTERN, out="again")
    for row in back.collect():
        assert bytes(row.again) == (row.text or "").encode()
