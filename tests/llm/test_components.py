import random
import tracemalloc

import numpy as np

from satzwerk.llm.components import roots, spread


def test_against_union_find(spark):
    chosen = random.Random(2)
    edges = [(chosen.randint(0, 300), chosen.randint(0, 300)) for _ in range(170)]
    edges += [(i, i + 1) for i in range(1000, 1100)] + [(5000, i) for i in range(4000, 4300)] + [(7, 7), (7, 8), (8, 7)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    found = {r.u: r.root for r in roots(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert found == {i: find(i) for i in list(root) if find(i) != i}


def test_a_large_matrix_of_links_takes_little_memory():
    linked = np.eye(2048, dtype=bool)
    linked[3:, 3] = linked[3, 3:] = True
    tracemalloc.start()
    found = spread(linked)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.tolist() == [0, 1, 2, *[3] * 2045]
    assert peak < 8 << 20
    assert spread(np.zeros((0, 0), dtype=bool)).tolist() == []


def test_no_links(spark):
    assert roots(spark.createDataFrame([], "u bigint, v bigint")).collect() == []
