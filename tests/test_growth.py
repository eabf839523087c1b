"""What a query sends and holds grows no faster than its texts."""

import numpy as np
import pyarrow as pa

from satzwerk.operators import alignment as al, answers as an, correction as co, tokens as tk
from satzwerk.operators.lexicon import Rewrites


def test_backends_take_a_batch_in_slices(monkeypatch):
    monkeypatch.setattr(co, "SLICE_BYTES", 1000)
    batch = pa.RecordBatch.from_pydict({"tokens": [["word"] * 10] * 200 + [None]})
    parts = list(co.slices(batch))
    assert max(part.nbytes for part in parts) < 2000
    assert [row for part in parts for row in part.column("tokens").to_pylist()] == batch.column("tokens").to_pylist()


def test_pairs_searched_together_are_few(monkeypatch):
    sizes, band = [], al._band

    def seen(pairs, low, high, kept, whole=None):
        sizes.append(len(pairs) * max(len(a) for a, _ in pairs) * (low + high + 1))
        return band(pairs, low, high, kept, whole)

    monkeypatch.setattr(al, "SIDE_CELLS", 10_000)
    monkeypatch.setattr(al, "_band", seen)
    a = np.arange(40)
    found = al.aligned([(a, np.r_[a[:20], 99, a[22:], 7])] * 300)
    assert max(sizes) <= 10_000 and len(sizes) > 1
    assert len({tuple(edits) for edits in found}) == 1


def test_open_requests_are_counted_by_their_keys(spark, tmp_path, monkeypatch):
    frame = spark.createDataFrame([(1, ["a", 'b"']), (2, ["a", 'b"']), (3, []), (4, [None]), (5, None)], "text_id bigint, tokens array<string>")
    plans, count = [], type(frame).count

    def seen(self):
        plans.append(self._jdf.queryExecution().optimizedPlan().toString())
        return count(self)

    monkeypatch.setattr(type(frame), "count", seen)
    store = str(tmp_path / "store")
    assert [an.answer_open_requests(frame, co.identity_corrector, store) for _ in range(2)] == [3, 0]
    assert len(plans) == 2 and not any("n_texts" in plan for plan in plans)
    kept = {tuple(r.tokens) for r in spark.read.parquet(store).collect()}
    assert kept == {("a", 'b"'), (), (None,)}


def test_offsets_need_no_window_for_ids_that_stand_once(spark):
    rows = [(1, " Ja! Du  da."), (2, ""), (None, "x"), (3, "Er. Ich"), (3, "Er. Ich"), (4, None)]
    frame = spark.createDataFrame(rows, "text_id bigint, text string")
    found = sorted((tuple(r) for r in tk.token_offsets(frame).collect() if r.text_id in (1, None)), key=repr)
    assert found == sorted(
        [
            (1, 0, 0, 0, "Ja", 1, 3), (1, 1, 0, 1, "!", 3, 4), (1, 2, 1, 0, "Du", 5, 7), (1, 3, 1, 1, "da", 9, 11),
            (1, 4, 1, 2, ".", 11, 12), (None, 0, 0, 0, "x", 0, 1),
        ],
        key=repr,
    )
    once = tk._offsets_once(frame.toDF("_id", "_text"))
    plan = once._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan
    both = sorted(r.end_char for r in tk.token_offsets(frame).where("text_id = 3").collect())
    assert both == [2, 4, 5, 6, 10, 14]


def test_kept_rows_of_rules_are_looked_up_once(spark):
    rows = [(1, ["a", "b", "c", "d"]), (1, ["a", None, "x", "d"]), (None, ["d"]), (2, []), (3, None), (1, ["a", "b", "c", "d"])]
    texts = spark.createDataFrame(rows, "text_id bigint, tokens array<string>")
    rules = [(1, ["d"], ["D"]), (2, ["a", "b"], ["AB"]), (3, ["a", "b", "c"], ["ABC"]), (3, ["a", "b", "c"], ["Z"])]
    frame = spark.createDataFrame(rules, "n int, src array<string>, dst array<string>")
    for limits in ({"inline_bytes": 0}, {"inline_bytes": 0, "broadcast_bytes": 0}):
        rewrites = Rewrites.from_frame(frame, **limits)
        plan, done = (co.rewrite_tokens(texts, rewrites, "tokens", "out", keep=keep) for keep in (False, True))
        assert done.columns == plan.columns
        assert sorted(map(tuple, done.collect()), key=repr) == sorted(map(tuple, plan.collect()), key=repr)
        shown = done._jdf.queryExecution().optimizedPlan().toString()
        assert shown.count("FlatMapCoGroupsInArrow") == 1
        # The rules come from their files and are not made again in each look-up.
        assert "min(value" not in shown
