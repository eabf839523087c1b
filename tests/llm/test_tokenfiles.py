import random
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from satzwerk.llm import tokenfiles as tf

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def known():
    tokenizer = tokenizers.Tokenizer.from_file(PATH)
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("ids", [[], [7], [0] * 128, list(range(500)), [2**32 - 1, 0, 5], [1, 1, 49000] * 100, [3] * 127 + [2**31]])
def test_blocks_round_trip(ids):
    ids = np.array(ids, dtype=np.uint32)
    page = tf.pack(ids)
    assert (tf.unpack(page, len(ids)) == ids).all()
    filled = np.concatenate([ids, np.zeros(-len(ids) % tf.BLOCK, dtype=np.uint32)]).reshape(-1, tf.BLOCK)
    for number in range(len(filled)):
        part = tf.unpack_block(page, number)
        assert (part[: len(ids) - number * tf.BLOCK] == filled[number][: len(ids) - number * tf.BLOCK]).all()


def test_random_blocks_and_outliers():
    random = np.random.default_rng(1)
    for top in (2, 300, 50_000, 2**32):
        ids = random.integers(0, top, 3000, dtype=np.uint64).astype(np.uint32)
        ids[random.integers(0, 3000, 100)] //= 1000
        assert (tf.unpack(tf.pack(ids), 3000) == ids).all()
    few = np.full(1280, 3, dtype=np.uint32)
    few[::64] = 60_000
    assert len(tf.pack(few)["packed"]) == 0 and len(tf.pack(few)["exception_places"]) == 20


@pytest.mark.parametrize("text", [
    "It's <|endoftext|>!", "a<|endoftext|>b", "<|ENDOFTEXT|> x", "<|end oftext|>", "BELGESİ. TARİHİ, YERİ", "İ!", "ŉ. ǰ! ẗ, ẖ.",
    "Àé'ß ΣΑΣ İ\x1c\x1dx\x85y z", "é ́a 日本!", "…so… (x).y'll", " a  b\r\n",
])
def test_stretches_change_nothing(known, text):
    assert np.frombuffer(tf.word_tokenizer(PATH)(text), dtype="<u4").tolist() == known(text)


def test_any_characters_in_stretches(known):
    """Letters whose lower case is longer, combining marks, signs and digits, in front of marks and not."""
    chosen = random.Random(6)
    odd = "İIiıŉǰΐẖẗẘẙẚßﬁÅÅÄʼnΣσςǅǈ\u0307\u0301\u0345ªº²½ٱ٣अाक्षไทย한국日本\u00ad\u200d\u00a0\u2003"
    pool = [*odd, *"abzAZ09_'’", *tf.MARKS, " ", " ", "\n", "\t", "\x1f"]
    pool += [c for c in map(chr, range(0xA1, 0x600)) if c.isprintable()]
    encode = tf.word_tokenizer(PATH)
    for _ in range(4000):
        text = "".join(chosen.choices(pool, k=chosen.randint(1, 14)))
        assert np.frombuffer(encode(text), dtype="<u4").tolist() == known(text), ascii(text)


def test_files_of_the_whole_table(spark, docs, rows, known, tmp_path, monkeypatch):
    monkeypatch.setattr(tf, "PAGE_IDS", 2000)
    path = str(tmp_path / "files")
    tf.write_ids(docs, path, PATH, 2, file_bytes=40_000)
    assert len(list((tmp_path / "files").glob("*.parquet"))) > 2
    want, at = [], 0
    for doc_id, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1])):
        ids = np.array([*known(text or ""), 2], dtype="<u4")
        want.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    found = sorted(map(tuple, tf.read_digests(spark, path).collect()), key=lambda r: r[1])
    assert found == want
    ids = {r.start: bytes(r.ids) for r in tf.read_ids(spark, path).collect()}
    assert all(zlib.crc32(ids[start]) == crc for _, start, _, crc in want)


def test_no_documents(spark, empty, tmp_path):
    tf.write_ids(empty, str(tmp_path / "none"), PATH, 2)
    assert tf.read_digests(spark, str(tmp_path / "none")).collect() == []


def test_plain_words_go_to_the_model_alone():
    tokenizer = tokenizers.Tokenizer.from_file(PATH)
    assert tf.takes_words_whole(tokenizer)
    tokenizer.pre_tokenizer = tokenizers.pre_tokenizers.Whitespace()
    assert not tf.takes_words_whole(tokenizer)
    tokenizer, encode = tokenizers.Tokenizer.from_file(PATH), tf.word_tokenizer(PATH)
    chosen = random.Random(3)
    for _ in range(3000):
        text = "".join(chosen.choices("abcdeßäöüñéÿÄÑ÷µªıİ́ǆ'- 1.", k=chosen.randint(1, 9)))
        assert encode(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes(), text
