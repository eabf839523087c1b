import hashlib
import math
import re
from collections import defaultdict

import pytest

from satzwerk.llm import mixing


def targets(sizes, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    total, full = 1.5 * sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in full]
        if not rest:
            return full
        level = (total - sum(full.values())) / sum(weight[s] for s in rest)
        over = [s for s in rest if level * weight[s] > 2 * sizes[s] + 1e-9]
        if not over:
            return full | {s: level * weight[s] for s in rest}
        full |= {s: 2.0 * sizes[s] for s in over}


def brute(rows, quality):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by = defaultdict(list)
    for doc_id, text, _, source, _ in rows:
        u = (int(hashlib.md5(("" if doc_id is None else str(doc_id)).encode()).hexdigest()[:12], 16) + 0.5) / 16**12
        by[source].append((-math.log(u) / {1: 2.0, 0: 0.5, None: 1.0}[quality.get(doc_id)], doc_id if doc_id is not None else -1, size(text), doc_id))
    sizes = {s: sum(r[2] for r in group) for s, group in by.items()}
    want, out = targets(sizes), []
    for source, group in by.items():
        epochs = math.floor(want[source] / sizes[source]) if sizes[source] else 0
        rest, at = math.floor(want[source] - epochs * sizes[source] + 0.5), 0
        for _, _, n, doc_id in sorted(group):
            out.append((doc_id, n, sizes[source], round(want[source], 6), epochs * n + min(max(rest - at, 0), n)))
            at += n
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(100 + n, n % 2, 0) for n in range(0, 40)] + [(100, 1, 1), (None, 1, 0)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


@pytest.mark.parametrize("bin_rows", [4096, 3])
def test_against_plain_python(docs, rows, labels, monkeypatch, bin_rows):
    monkeypatch.setattr(mixing, "BIN_ROWS", bin_rows)
    quality = {100 + n: n % 2 for n in range(40)} | {100: 1}
    found = [(r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in mixing.mix(docs, labels).collect()]
    assert sorted(found, key=repr) == brute(rows, quality)
    assert all(0 <= r[4] <= 2 * r[1] for r in found)


def test_small_sources_are_cut_at_twice_their_size(spark):
    sizes = {"a": 10, "b": 1000, "c": 3, None: 500, "é": 0}
    frame = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size bigint, source_rows bigint")
    found = {r.source: r.target for r in mixing.source_targets(frame).collect()}
    assert found == pytest.approx(targets(sizes))
    assert sum(found.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_the_mix_as_documents(docs):
    mixed = mixing.mix(docs, carry=tuple(docs.columns))
    out = mixing.expand(mixed, docs.columns)
    assert out.columns == docs.columns
    taken = {r.doc_id: r for r in mixed.collect()}
    counts = defaultdict(int)
    for row in out.collect():
        counts[row.doc_id] += 1
    repeated = max(set(r.doc_id for r in mixed.collect()), key=[r.doc_id for r in mixed.collect()].count)
    for doc_id, row in taken.items():
        if doc_id != repeated:
            assert counts[doc_id] == (math.ceil(row.taken / row["size"]) if row["size"] else 0)


def test_no_python_runs_and_empty_tables(docs, empty, labels):
    plan = mixing.mix(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert mixing.mix(empty, labels).collect() == []


def test_carried_columns_may_have_any_name(docs):
    odd = docs.selectExpr("*", "7 AS `_`", "8 AS _doc", "9 AS _w", "doc_id AS _key")
    mixed = mixing.mix(odd, carry=tuple(odd.columns))
    given = mixing.expand(mixed, odd.columns).collect()
    assert given and {(r["_"], r["_doc"], r["_w"]) for r in given} == {(7, 8, 9)} and all(r._key == r.doc_id for r in given)
