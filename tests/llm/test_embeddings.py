import numpy as np
import pytest
from pyspark.sql import functions as F

from satzwerk.llm import embeddings as em

TYPE = "vec_id bigint, embedding array<float>, label int"


def brute(rows, threshold=0.93):
    """Links of each row and the smallest id it reaches."""
    def usable(v, label):
        return label is not None and v and None not in v and np.isfinite(v).all() and np.any(v)

    units = [np.float32(v).astype(float) / np.linalg.norm(np.float32(v).astype(float)) if usable(v, l) else None for _, v, l in rows]
    links = {i: [j for j in range(len(rows)) if i != j and units[i] is not None and units[j] is not None
                 and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= threshold] for i in range(len(rows))}
    out = []
    for i, (vec_id, *_) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            new = [k for k in links[todo.pop()] if k not in seen]
            seen |= set(new)
            todo += new
        root = min(rows[k][0] for k in seen)
        out.append((vec_id, len(links[i]), root, root == vec_id))
    return sorted(out)


def clustered(count, seed, size=32):
    random = np.random.default_rng(seed)
    out = []
    while len(out) < count:
        center = random.standard_normal(size)
        for _ in range(random.integers(1, 12)):
            out.append((len(out), (center + random.uniform(0, 0.35) * random.standard_normal(size)).tolist(), int(random.integers(0, 2))))
    return out[:count]


def test_against_all_pairs(spark):
    rows = clustered(500, 1)
    rows += [(500 + i, rows[i][1], rows[i][2]) for i in range(40)]  # exact copies
    nan, inf = float("nan"), float("inf")
    rows += [(600, None, 1), (601, [], 1), (602, [0.0] * 32, 1), (603, [nan] * 32, 1), (604, [inf] + [0.0] * 31, 1),
             (605, [1.0] * 31 + [None], 1), (606, rows[0][1], None), (607, rows[0][1][:16], rows[0][2]), (608, [2.0], 1), (609, [3.0], 1), (610, [-1.0], 1)]
    frame = spark.createDataFrame(rows, TYPE).withColumn("weight", F.lit("x")).withColumn("block", F.lit(1))
    found = sorted(map(tuple, em.near_duplicates(frame).collect()))
    assert found == brute(rows)
    assert any(r[1] > 1 for r in found) and not all(r[3] for r in found)


def test_large_buckets_are_split(spark, monkeypatch):
    monkeypatch.setattr(em, "BLOCK", 16)
    random = np.random.default_rng(2)
    center = random.standard_normal(32)
    rows = [(i, (center + random.uniform(0, 0.4) * random.standard_normal(32)).tolist(), 1) for i in range(150)]
    assert sorted(map(tuple, em.near_duplicates(spark.createDataFrame(rows, TYPE)).collect())) == brute(rows)


def test_recall_at_the_threshold():
    random = np.random.default_rng(4)
    code, first = em.Code(64), random.standard_normal((600, 64))
    first /= np.linalg.norm(first, axis=1, keepdims=True)
    other = random.standard_normal((600, 64))
    other -= (other * first).sum(1, keepdims=True) * first
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    sets = []
    for part in (first, 0.931 * first + np.sqrt(1 - 0.931**2) * other):
        rows, filters = code.decode(part)
        assert (np.diff(rows) >= 0).all() and all(np.diff(filters[rows == 0]) > 0)
        sets.append([set(filters[rows == i]) for i in range(600)])
    assert sum(not a & b for a, b in zip(*sets, strict=True)) <= 3


def test_decoding_finds_every_direction_above_the_height():
    code = em.Code(12, tables=1, parts=3, codes=5, height=1.0)
    x = np.random.default_rng(0).standard_normal((4, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    parts = [x @ words for words in code.tables[0]]
    total = parts[0][:, :, None, None] + parts[1][:, None, :, None] + parts[2][:, None, None, :]
    want = [np.flatnonzero(t.reshape(-1) >= code.need).tolist() for t in total]
    rows, filters = code.decode(x)
    assert [filters[rows == i].tolist() for i in range(4)] == want


def test_empty(spark):
    assert em.near_duplicates(spark.createDataFrame([], TYPE)).collect() == []


def test_vectors_without_an_id_link_with_nothing(spark):
    rows = [(None, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (None, [1.0, 0.0], 1)]
    found = em.near_duplicates(spark.createDataFrame(rows, TYPE)).collect()
    assert sorted(map(repr, (tuple(r) for r in found))) == sorted(map(repr, [(None, 0, None, True)] * 2 + [(1, 1, 1, True), (2, 1, 1, False)]))
