"""Edit scripts: C6."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from satzwerk.functions import fixed
from satzwerk.operators import alignment as al


def least(a, b):
    """Fewest edits and, among those, fewest deletions, by the plain table."""
    row = [(j, 0) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        new = [(i, i)]
        for j, y in enumerate(b, 1):
            keep = (row[j - 1][0] + (x != y), row[j - 1][1])
            new.append(min(keep, (row[j][0] + 1, row[j][1] + 1), (new[j - 1][0] + 1, new[j - 1][1])))
        row = new
    return row[-1]


def replayed(a, b, edits):
    """The list that a script makes of ``a``; places after have to agree too."""
    out, at = [], 0
    for step, i, j in edits:
        out += a[at:i]
        assert len(out) == j
        at = i
        if step != al.INSERT:
            at += 1
        if step != al.DELETE:
            out.append(b[j])
    return out + a[at:]


def pairs_of(seed, n=60):
    chosen = random.Random(seed)
    for _ in range(n):
        a = chosen.choices(range(chosen.choice([2, 5, 200])), k=chosen.randint(0, 60))
        b = list(a)
        for _ in range(chosen.choice([0, 1, 2, 5, 40])):
            at = chosen.randint(0, len(b))
            chosen.choice([lambda: b.insert(at, chosen.randint(0, 5)), lambda: b[at : at + 1].clear() or b.__delitem__(slice(at, at + 1)),
                           lambda: b.__setitem__(slice(at, at + 1), [chosen.randint(0, 5)])])()
        yield np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
    yield np.arange(0), np.arange(0)
    yield np.arange(50), np.arange(100, 120)


@pytest.mark.parametrize("cells", [1 << 25, 2000, 60])
def test_scripts_are_shortest_with_fewest_deletions(monkeypatch, cells):
    monkeypatch.setattr(al, "CELLS", cells)
    pairs = list(pairs_of(cells))
    for (a, b), edits in zip(pairs, al.aligned(pairs), strict=True):
        assert replayed(a.tolist(), b.tolist(), edits) == b.tolist()
        assert (len(edits), sum(step == al.DELETE for step, _, _ in edits)) == least(a.tolist(), b.tolist())


def test_a_long_text_with_few_edits():
    a = np.random.default_rng(1).integers(0, 5000, 40_000)
    b = np.insert(np.delete(a, [5, 30_000]), [100, 20_000, 39_000], -5)
    [edits] = al.aligned([(a, b)])
    assert sorted(step for step, _, _ in edits) == [al.DELETE] * 2 + [al.INSERT] * 3


def audit_of(spark, *rows):
    frame = spark.createDataFrame(list(rows), "b array<string>, a array<string>")
    return [r.x for r in frame.select(al.edit_audit(F.col("b"), F.col("a")).alias("x")).collect()]


def test_an_insertion_in_front_changes_nothing_else(spark):
    [row] = audit_of(spark, (list("abcd"), list("xabcd")))
    assert (row.n_changed, row.n_inserted, row.n_deleted, row.flag_deleted, row.flag_shorter) == (0, 1, 0, False, False)
    assert [tuple(e) for e in row.script] == [("insert", 0, None, "x")]


def test_repeats_nulls_and_empty_lists(spark):
    rows = audit_of(spark, (["a", "a", "a"], ["a"]), (None, ["a"]), (["a"], None), ([], []), ([], ["x", "y"]), ([None, "a"], [None, "b"]))
    assert (rows[0].n_deleted, rows[0].flag_deleted, rows[0].flag_shorter) == (2, True, True)
    assert rows[1] is None and rows[2] is None
    assert (rows[3].n_before, rows[3].n_after, rows[3].script) == (0, 0, [])
    assert rows[4].n_inserted == 2
    assert [tuple(e) for e in rows[5].script] == [("change", 1, "a", "b")]


def test_worked_examples_delete_only_where_tokens_merge(spark):
    """``Haand Figure`` becomes one word in the first, ``, ,`` one mark in the fifth."""
    rows = audit_of(spark, *((before.split(" "), after.split(" ")) for before, after in fixed.WORKED_PAIRS))
    assert [r.flag_deleted for r in rows] == [True, False, False, False, True, False]
    assert [r.n_inserted - r.n_deleted for r in rows] == [1, 1, 0, 0, -1, 1]


def test_edit_table(spark):
    frame = spark.createDataFrame([(7, ["a", "b"], ["a", "c", "."]), (8, ["a"], ["a"])], "text_id bigint, b array<string>, a array<string>")
    rows = al.edit_table(frame, "b", "a", "text_id").collect()
    assert sorted(map(tuple, rows)) == [(7, 0, "insert", 1, None, "c"), (7, 1, "change", 1, "b", ".")]


def test_the_query_equals_the_plain_table(spark):
    """All documents of the smallest tables, the plain table for those of moderate length."""
    from satzwerk.plans import registry

    folder = "/root/testdata/sf0.001"
    lists = {r.doc_id: r for r in registry._corrected(spark, folder).select("doc_id", "tokens", "corrected_tokens").collect()}
    rows = registry.correction_edits(spark, folder).collect()
    assert {r.doc_id for r in rows} == set(lists) and len(rows) == len(lists)
    compared = 0
    for r in rows:
        b, a = lists[r.doc_id].tokens, lists[r.doc_id].corrected_tokens
        assert (r.n_before, r.n_after, r.flag_shorter, r.flag_deleted) == (len(b), len(a), len(a) < len(b), r.n_deleted > 0)
        assert r.n_inserted - r.n_deleted == len(a) - len(b)
        if len(b) < 250:
            assert (r.n_changed + r.n_deleted + r.n_inserted, r.n_deleted) == least(b, a)
            compared += 1
    assert compared > 20
