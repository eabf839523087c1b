import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from satzwerk.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, first):
    """Collocations of (lang, text) by plain Python."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, *words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    chosen = {key: a for key, a in f.items() if len(key) > 2 and a >= least}
    covered = set()
    for (lang, *words), a in chosen.items():
        if len(words) == 3:
            covered |= {(lang, *part) for part in (words[:2], words[1:]) if 100 * a >= 50 * f[(lang, *part)]}
    found = []
    for (lang, *words), a in chosen.items():
        if (lang, *words) in covered:
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = f[(lang, *words[:k])], f[(lang, *words[k:])]
            cuts.append((1000000 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        found.append((lang, -score, -a, " ".join(words).encode(), a, left, right))
    rows, rank = [], Counter()
    for lang, score, _, phrase, a, left, right in sorted(found):
        rank[lang] += 1
        if rank[lang] <= first:
            rows.append((lang, rank[lang], phrase.decode(), a, left, right, n[lang], -score))
    return rows


def texts():
    chosen = random.Random(5)
    words = ["a", "A", "the", "The", "ß", "É", "x\x00y", "b c", " ", "new", "york", "city", "日本", "\U0001f600"]
    rows = []
    for _ in range(300):
        said = chosen.choices(words, weights=range(1, len(words) + 1), k=chosen.randint(0, 40))
        text = "".join(w + chosen.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "\r\n", "\x0b", ":", " \x1c "]) for w in said)
        rows.append((chosen.choice(["de", "en", None, "und", ""]), text))
    rows += [(None, None), ("en", ""), ("en", " \t \n"), ("zz", "..."), ("fr", "ha " * 400), ("it", "one two three. " * 12), ("it", "one two")]
    return rows


@pytest.mark.parametrize(("least", "first", "size"), [(10, 2000, 1 << 20), (4, 40, 150), (300, 5, 100)])
def test_phrases_equal_a_plain_count(spark, least, first, size):
    rows = texts()
    frame = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 AS f", "2 AS id", "'x' AS word", "0 AS a").repartition(5)
    found = phrases.collocations(frame, least, first, size)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == sorted(brute(rows, least, first))


def test_documents_with_copies_and_long_texts(docs, rows, monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 5000)
    found = phrases.collocations(docs)
    assert sorted(map(tuple, found.collect())) == sorted(brute([(r[2], r[1]) for r in rows], 10, 2000))


def test_stretches_cut_no_word(monkeypatch):
    text = "Ab cd. Ef gh, i " * 50 + "z" * 900 + " end."
    whole = [w for words in phrases.words_of(text) for w in words if w]
    monkeypatch.setattr(phrases, "STRETCH", 30)
    assert [w for words in phrases.words_of(text) for w in words if w] == whole
    assert len(list(phrases.words_of(text))) > 20


def test_empty_tables(spark, empty):
    assert phrases.collocations(empty).collect() == []
    lone = spark.createDataFrame([(None, None), ("de", "only once said")], "lang string, text string")
    assert phrases.collocations(lone).collect() == []


@pytest.mark.parametrize(("words", "largest", "n"), [(1, 300, 200), (2, 40, 600), (3, 70_000, 5000), (2, 20_000_000, 3000)])
def test_a_trie_finds_its_phrases_alone(words, largest, n):
    chosen = np.random.default_rng(words)
    known = np.unique((chosen.random((n, words)) ** 3 * largest).astype(np.int64) + 1, axis=0)
    trie = phrases.Trie(known)
    noise = (chosen.random(20_000) ** 3 * largest * 1.3).astype(np.int32)
    ids = np.concatenate([noise, known[: n // 2].astype(np.int32).reshape(-1), np.zeros(1, dtype=np.int32), noise[:50]])
    at, found = trie.walk(ids)
    place = {tuple(row): i for i, row in enumerate(known.tolist())}
    windows = [tuple(ids[i : i + words].tolist()) for i in range(len(ids) - words + 1)]
    assert dict(zip(at.tolist(), found.tolist(), strict=True)) == {i: place[w] for i, w in enumerate(windows) if w in place}


def test_scores_stay_exact_beyond_64_bits(spark):
    a, l, r = 3_000_000_007, 3_000_000_011, 4_000_000_019  # noqa: E741
    wide = "CAST({} AS DECIMAL(16, 0))".format
    found = spark.sql(f"SELECT (1000000 * {wide(a)} * {wide(a)}) DIV ({wide(l)} * {wide(r)})").first()[0]
    assert found == 1000000 * a * a // (l * r)


def test_only_frequent_phrases_come_back(spark):
    text = " ".join(f"w{i % 97} w{i % 89}" for i in range(3000))
    blocks = phrases.pack_blocks(spark.createDataFrame([("de", text)] * 6, "lang string, text string").repartition(6))
    words = phrases.numbered(blocks.where("codes IS NULL").groupBy("lang", "word").agg(F.sum("n").alias("f")), "test-words")
    ids = phrases.number_words(blocks, words.select("lang", "word", "id"))
    pairs = phrases.numbered(phrases.candidates(ids, ["w1", "w2"], 16, 1), "test-pairs")
    all_counts = {r.id: r.f for r in phrases.count_phrases(ids, pairs, ["w1", "w2"], 1 << 20).collect()}
    assert len(all_counts) == pairs.count() > 4000
    least = sorted(all_counts.values())[-20]
    found = {r.id: r.f for r in phrases.count_phrases(ids, pairs, ["w1", "w2"], 1000, least).collect()}
    assert found == {i: f for i, f in all_counts.items() if f >= least}


def test_the_driver_holds_one_trie_at_a_time(spark):
    known = spark.range(1, 301).selectExpr("id", "CAST(id AS INT) AS w1", "CAST(id + 1 AS INT) AS w2")
    seen = []
    for start, sent in phrases.portions(known, ["w1", "w2"], 100):
        assert sent.value.walk(np.array([start + 5, start + 6], dtype=np.int32))[1].tolist() == [4]
        seen.append(sent)
    assert len(seen) == 3
    for sent in seen:  # all are destroyed
        with pytest.raises(Exception):
            spark.sparkContext.parallelize([0], 1).map(lambda _, sent=sent: sent.value.words).collect()


def test_buckets_that_sieve_nothing_let_no_rare_phrase_into_a_trie(spark, monkeypatch):
    rows, tries, phrase_rows = texts(), [], phrases._phrase_rows
    monkeypatch.setattr(phrases, "bits_for", lambda occurrences: 16)
    monkeypatch.setattr(phrases, "_bucket", lambda left, right, bits: np.zeros(len(left), dtype=np.int64))
    monkeypatch.setattr(phrases, "HELD", 50)
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(phrases, "_phrase_rows", lambda *some: tries.append(phrase_rows(*some)) or tries[-1])
    frame = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    _, _, pairs, triples = phrases.counted_phrases(frame, 3, 20)
    for n, found in ((2, pairs), (3, triples)):
        rows_of = [t for t in tries if t.shape[1] == n]
        assert sum(map(len, rows_of)) == found.count() * (2 if n == 2 else 1)  # pairs are walked for counts and for states
        assert found.count() > 20 and found.where("f < 3").count() == 0
        counts = rows_of[: -(-found.count() // 20)]
        assert len(counts) > 1 and all(a[:, 0].max() <= b[:, 0].min() for a, b in zip(counts, counts[1:]))
