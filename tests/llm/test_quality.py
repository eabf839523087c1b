import random
import re
from collections import Counter

import pyarrow.parquet as pq
import pytest

from satzwerk.llm import quality
from tests.llm.conftest import prose


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    repeated = {k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    seen, doubled = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            doubled += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(repeated) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), doubled, len(repeated), failed


def test_counts_of_every_document(docs, rows, empty):
    found = Counter(tuple(r)[:7] for r in quality.judge(docs).collect())
    assert found == Counter((d, *counts(t)) for d, t, *_ in rows)
    assert quality.judge(empty).collect() == []


def test_random_lines():
    chosen, bands = random.Random(1), quality.Bands()
    for _ in range(300):
        text = "".join(chosen.choices(["a ", "b ", "c#", "\n", "x y\n", "\r", "\x0b", "é|"], k=chosen.randint(0, 80)))
        assert quality.measure(text, bands)[:6] == counts(text)


def test_bands_reject_fillers_and_noise_and_keep_prose():
    bands, noise = quality.Bands(), random.Random(2)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    random_text = " ".join("".join(noise.choices(letters, k=60)) for _ in range(80))
    assert not bands.look(random_text.encode())[3]
    assert not bands.look(("kaufen sie jetzt billig " * 40).encode())[3]
    assert bands.look(b"") == (1.0, 1.0, 1.0, False)
    hidden = prose(1, 400) + " " + "abc " * 1500 + prose(2, 400)  # a bad stretch inside
    assert bands.look(hidden.encode())[1] < 0.1


def test_kept_documents_keep_all_columns(docs):
    kept = quality.keep(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in quality.judge(docs).where("kept").collect())
    assert {r.n_chars for r in kept.collect()} <= {None, 5}


def labelled():
    """Data, language and label of the labelled documents that pass the base rules."""
    folder, bands = "/root/testdata/sf0.1", quality.Bands()
    labels = dict(zip(*(c.to_pylist() for c in pq.read_table(f"{folder}/labels.parquet", columns=["doc_id", "quality"]).columns)))
    rows = pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text", "lang"]).to_pylist()
    rows = [r for r in rows if r["doc_id"] in labels and not quality.measure(r["text"], bands)[5]]
    return [(r["text"].encode(), r["lang"], labels[r["doc_id"]]) for r in rows]


@pytest.mark.parametrize("size", [1 << 16, 1 << 19, 1 << 20, 1 << 21, 1 << 22])
def test_long_clean_prose_is_kept_in_each_language(size):
    bands, rows = quality.Bands(), labelled()
    for lang in ("de", "en", "es", "fr"):
        words = [w for data, of, label in rows if of == lang and label == 1 for w in data.split()]
        text = b" ".join(random.Random(size).choices(words, k=size // 4))[:size]
        assert bands.look(text)[3], lang


def test_short_bad_texts_and_bad_tails_are_rejected():
    bands, rows = quality.Bands(), labelled()
    kept = Counter((label, bands.look(data)[3]) for data, _, label in rows)
    assert kept[1, False] == 0 and kept[0, True] < 100
    good = next(data for data, _, label in rows if label == 1 and 4200 < len(data) < 6000)
    for size in (1100, 4096):  # the bad stretch is less than a chunk, at the end
        assert bands.look(good[:size])[3]
        assert not bands.look(good[:size] + b" 7Qx9 0Zk4" * 40)[3]


#: The first letter of each alphabet's row of 26.
ALPHABETS = {"Greek": 0x3B1, "Cyrillic": 0x430, "Arabic": 0x621, "Devanagari": 0x905, "Chinese signs": 0x4E00}


@pytest.mark.parametrize("alphabet", ALPHABETS)
def test_verdicts_are_alike_in_every_alphabet(alphabet):
    bands, spelled = quality.Bands(), {ord("a") + i: ALPHABETS[alphabet] + i for i in range(26)}
    texts = [data.decode() for data, _, label in labelled()[::3] if label == 1]
    verdicts = [quality.measure(text.translate(spelled), bands)[quality.KEPT] for text in texts]
    assert sum(verdicts) >= 0.95 * len(texts)
    noise = random.Random(4)
    letters = [chr(n) for n in spelled.values()] + list("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
    junk = [" ".join("".join(noise.choices(letters, k=60)) for _ in range(80)), ("kaufen sie jetzt billig " * 40).translate(spelled)]
    assert not any(quality.measure(text, bands)[quality.KEPT] for text in junk)


def test_letters_of_latin_texts_stay():
    for text in ("Müße – „so“ …", "plain", "ÀĐ\u1e9e €"):
        assert quality.as_letters(text, text.encode()) == text.encode()
    mixed = "Das ist ж, nicht ü"
    assert quality.as_letters(mixed, mixed.encode()) == "Das ist ".encode() + b"\xb6" + ", nicht ü".encode()
