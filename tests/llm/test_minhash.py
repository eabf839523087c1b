import random

import numpy as np
import pytest

from satzwerk.llm import minhash as mh
from tests.llm.conftest import prose


def brute(rows, width, percent):
    sets = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            sets.setdefault(doc_id, []).append(mh.shingle_set(text, width))
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    out = []
    for doc_id, text, *_ in rows:
        size = len(mh.shingle_set(text, width))
        out.append((doc_id, size, None if doc_id is None else find(doc_id), doc_id is None or find(doc_id) == doc_id))
    return sorted(out, key=repr)


@pytest.mark.parametrize("width, percent", [(3, 85), (5, 80)])
def test_against_all_pairs(docs, rows, empty, width, percent):
    found = sorted(map(tuple, mh.near_duplicates(docs, width, percent).collect()), key=repr)
    assert found == brute(rows, width, percent)
    assert mh.near_duplicates(empty, width, percent).collect() == []


@pytest.mark.parametrize("block", [512, 7])
def test_groups_around_the_threshold(spark, monkeypatch, block):
    """Groups whose members are near some of the others only."""
    monkeypatch.setattr(mh, "CLUSTER_BLOCK", block)
    monkeypatch.setattr(mh, "BUCKET_BLOCK", block)
    chosen, rows = random.Random(8), []
    for group in range(4):
        base = prose(group, 120).split(" ")
        for copy in range(25):
            words = list(base)
            for k in chosen.sample(range(len(words)), copy % 12):
                words[k] = f"w{chosen.random()}"
            rows.append((len(rows), " ".join(words)))
    chosen.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = sorted(map(tuple, mh.near_duplicates(frame, 3, 85).collect()), key=repr)
    assert found == brute(rows, 3, 85)
    assert 4 < len({r[2] for r in found}) < 100


def test_every_pair_within_the_distance_shares_a_key():
    random_ = np.random.default_rng(3)
    for _ in range(300):
        one = random_.integers(0, 1 << mh.BITS, mh.POSITIONS).astype(np.uint64)
        other = one.copy()
        changed = random_.choice(mh.POSITIONS, mh.DISTANCE, replace=False)
        other[changed] ^= np.uint64(1)
        assert set(mh.index_keys(one)) & set(mh.index_keys(other))
    assert len(set(mh.index_keys(one))) == mh.CHUNKS * mh.CHUNK


def test_distance_follows_similarity():
    known, words = mh._WordHash(), [f"w{i}".encode() for i in range(1000)]
    one = mh.hashed_shingles(words, 1, known)
    apart = [np.count_nonzero(mh.signature(one) != mh.signature(mh.hashed_shingles(words[n:] + [f"x{i}{n}".encode() for i in range(n)], 1, known))) for n in (0, 80, 999)]
    assert apart[0] == 0 and 0 < apart[1] <= mh.DISTANCE < apart[2]


def test_first_of_each_group_stays(docs, rows):
    kept = mh.keep_first(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in brute(rows, 5, 80) if r[3]}
