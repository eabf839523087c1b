import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from satzwerk.llm import prefixes

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def brute(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    plain = {conv: [t[2:] for t in sorted(some)] for conv, some in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for conv in sorted(plain):
        h = zlib.crc32(str(conv).encode()) % 9
        base = conv - (conv % 5 if conv >= 0 else -(-conv % 5))
        path = tuple(plain.get(base, [])[:h] + plain[conv][h:])
        ends[path].append(conv)
        for d in range(len(path) + 1):
            members[path[:d]].append(conv)
    found = {}
    for path in sorted(members, key=len, reverse=True):
        children = [p for p in found if len(p) == len(path) + 1 and p[: len(path)] == path]
        own = (len(members[path]) - 1) * (len(path[-1][1].encode()) if path else 0)
        found[path] = (
            members[path][0], len(path), members[path[:-1]][0] if path else None, len(members[path]), len(children),
            sum(found[c][5] for c in children) or 1, own + sum(found[c][6] for c in children),
            hashlib.sha256(",".join(map(str, ends.get(path, []))).encode()).hexdigest(),
        )
    return sorted(map(repr, found.values()))


def conversations():
    chosen = random.Random(11)
    texts = ["", "hi", "ß", "how are you", None, "x\x00y", "\U0001f600 ok", "a" * 400 + "b", "a" * 400 + "c"]
    rows = []
    for conv in range(-12, 160):
        if conv % 7 == 3:
            continue
        for turn in range(chosen.choice([1, 2, 3, 5, 9, 12])):
            rows.append((conv, turn, chosen.choice(["user", "user", None, "", "assistant"]), chosen.choices(texts, weights=[9, 9, 9, 1, 1, 1, 1, 1, 1])[0]))
    rows += [(500 + k, turn, "user", "same") for k in range(40) for turn in range(3)]  # copies
    rows += [(1000, turn, "user", str(turn % 3)) for turn in range(700)]  # a third of all rows
    rows += [(1003, None, "user", "b"), (1003, None, "user", "a"), (1003, None, "user", "a"), (1003, 4, None, None), (1003, 4, "", "")]
    rows += [(None, 1, "user", "no id"), (2000, None, None, None), (2**62, 0, "user", "far"), (-(2**62), 0, "user", "far")]
    rows += rows[:5]
    chosen.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard", [1 << 17, 50])
def test_nodes_equal_plain_ones(spark, monkeypatch, shard):
    monkeypatch.setattr(prefixes, "SHARD", shard)
    monkeypatch.setattr(prefixes, "JOINED", 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        rows = conversations()
        frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS depth", "2 AS k1", "'x' AS any", "3 AS part", "4 AS turns").repartition(6)
        found = prefixes.prefix_trie(frame)
        assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
        assert sorted(repr(tuple(r)) for r in found.collect()) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_long_conversation_is_dealt_out(spark):
    rows = [(5, turn, "user", str(turn)) for turn in range(3000)] + [(1, 0, "user", "x")]
    parts = prefixes.in_order(spark.createDataFrame(rows, SCHEMA)).where("conv_id = 5").select("part").distinct().count()
    assert parts > 1


def test_no_conversations(spark):
    assert prefixes.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert prefixes.prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).collect() == []


def test_one_conversation_without_turns(spark):
    """Their first conversation is absent: what they had in its place is gone."""
    rows = [(1, 0, "user", "x"), (2, 0, "user", "x")]
    found = prefixes.prefix_trie(spark.createDataFrame(rows, SCHEMA))
    assert sorted(repr(tuple(r)) for r in found.collect()) == brute(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 30_000])
def test_slots_are_minimal_and_verified(n):
    chosen = np.random.default_rng(n)
    keys = np.unique(chosen.integers(-(2**62), 2**62, (n, 3)) >> chosen.integers(0, 61, (n, 3)), axis=0)
    slots = prefixes.Slots(keys)
    assert sorted(slots.of(keys).tolist()) == list(range(len(keys)))
    known = set(map(tuple, keys.tolist()))
    others = np.array([k for k in chosen.integers(0, 50, (500, 3)).tolist() if tuple(k) not in known])
    assert (slots.of(others) == -1).all()
