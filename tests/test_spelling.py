"""Misspellings no list holds, and answers that last: C1, C3, C5."""

import random

import pytest
from pyspark.sql import functions as F

from satzwerk.operators import answers as an, correction as co, spelling as sp, usage
from satzwerk.operators.lexicon import Rewrites


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute(words, rare, frequent, two_from):
    found = set()
    for word, n in words:
        if word is None or n > rare or len(word) < sp.SHORTEST:
            continue
        allowed = 2 if two_from is not None and len(word) >= two_from else 1
        near = [(distance(word, k), -m, k.encode(), k) for k, m in words if k is not None and m >= frequent and distance(word, k) <= allowed]
        if near:
            d, m, _, k = min(near)
            found.add((word, n, k, -m, d))
    return found


@pytest.mark.parametrize("two_from", [None, 8, 5])
def test_suggestions_equal_a_search_of_the_whole_vocabulary(spark, two_from):
    chosen = random.Random(8)
    known = {"".join(chosen.choices("aeßütrn", k=chosen.randint(3, 11))): chosen.randint(10, 14) for _ in range(200)}
    words = dict(known)
    for word in list(known):
        letters = list(word)
        for _ in range(chosen.choice([1, 1, 2, 3])):
            at = chosen.randrange(len(letters) + 1)
            letters[at : at + chosen.choice([0, 1])] = chosen.choice(["", "a", "ü"])
        words.setdefault("".join(letters), chosen.choice([1, 1, 2, 9]))
    rows = [*words.items(), (None, 1), ("", 1), ("läufd", 1), ("läuft", 20), ("laeuft", 1)]
    found = sp.suggestions(spark.createDataFrame(rows, "word string, n bigint"), two_from=two_from).collect()
    assert len(found) == len({r.word for r in found})
    assert set(map(tuple, found)) == brute(rows, 1, 10, two_from)
    assert ("läufd", 1, "läuft", 20, 1) in set(map(tuple, found))


def test_texts_are_corrected_from_their_own_vocabulary(spark):
    rows = [(n, "Der Hund läuft und spielt im Park.") for n in range(12)] + [(12, "Der Hunt läufd, er shpilt im Parc."), (13, None)]
    texts = spark.createDataFrame(rows, "text_id bigint, text string")
    found = sp.suggestions(sp.vocabulary(texts), two_from=6)
    done = {r.text_id: r.corrected for r in co.correct_spelling(texts, sp.as_rewrites(found)).collect()}
    assert done[12] == "Der Hund läuft, er spielt im Park."
    assert done[0] == "Der Hund läuft und spielt im Park."


def test_vocabulary_counts_letters_alone(spark):
    texts = spark.createDataFrame([("Ja ja ja-nein a1 x_y, ja",), (None,)], "text string")
    assert {tuple(r) for r in sp.vocabulary(texts).collect()} == {("Ja", 1), ("ja", 2)}


def test_empty_vocabulary_and_bounds(spark):
    none = spark.createDataFrame([], "word string, n bigint")
    assert sp.suggestions(none).collect() == []
    assert isinstance(sp.as_rewrites(sp.suggestions(none)), Rewrites)
    with pytest.raises(ValueError, match="less frequent"):
        sp.suggestions(none, rare=10, frequent=10)


# --- answers ----------------------------------------------------------------


def counting(folder, fails=()):
    def make():
        import tempfile

        def run(tokens):
            tempfile.mkstemp(dir=folder)
            if tokens and tokens[0] in fails:
                raise ValueError("no answer")
            return [t.upper() for t in tokens]

        return run

    return make


def frame_of(spark, *lists):
    return spark.createDataFrame(list(enumerate(lists)), "text_id bigint, tokens array<string>")


def test_a_second_run_calls_nothing(spark, tmp_path):
    calls, store = tmp_path / "calls", str(tmp_path / "store")
    calls.mkdir()
    frame = frame_of(spark, ["a"], ["a"], ["b", "c"], [], None).repartition(3)
    first = co.correct_spelling(frame, counting(calls), "tokens", answers_path=store).collect()
    assert len(list(calls.iterdir())) == 3
    again = co.correct_spelling(frame, counting(calls), "tokens", answers_path=store).collect()
    assert len(list(calls.iterdir())) == 3
    assert sorted(map(repr, first)) == sorted(map(repr, again))
    more = frame_of(spark, ["a"], ["d"])
    done = {tuple(r.tokens): r.corrected_tokens for r in an.correct_stored(more, counting(calls), store).collect()}
    assert done == {("a",): ["A"], ("d",): ["D"]} and len(list(calls.iterdir())) == 4


def test_failed_calls_are_made_again_on_request(spark, tmp_path):
    calls, store = tmp_path / "calls", str(tmp_path / "store")
    calls.mkdir()
    frame = frame_of(spark, ["a"], ["b"])
    assert an.answer_open_requests(frame, counting(calls, fails=("b",)), store) == 2
    errors = {r.key: r.error for r in an.read_answers(spark, store).collect()}
    assert sorted(errors.values(), key=repr) == ["ValueError: no answer", None]
    assert an.answer_open_requests(frame, counting(calls), store, retry=False) == 0
    assert an.answer_open_requests(frame, counting(calls), store) == 1
    rows = an.read_answers(spark, store).collect()
    assert len(rows) == 2 and {tuple(r.answer) for r in rows} == {("A",), ("B",)} and {r.error for r in rows} == {None}


def test_a_killed_run_keeps_what_its_tasks_answered(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(an, "TASK_REQUESTS", 10)
    calls, store = tmp_path / "calls", str(tmp_path / "store")
    calls.mkdir()
    frame = frame_of(spark, *[[f"t{n}"] for n in range(200)], ["bad"])
    with pytest.raises(Exception, match="no answer"):
        an.answer_open_requests(frame, counting(calls, fails=("bad",)), store, on_error="raise")
    kept = an.read_answers(spark, store).count()
    left = an.open_requests(frame, store).count()
    assert kept > 0 and kept + left == 201
    before = len(list(calls.iterdir()))
    assert an.answer_open_requests(frame, counting(calls), store) == left
    assert len(list(calls.iterdir())) == before + left
    assert an.answer_open_requests(frame, counting(calls), store) == 0


def test_no_store_and_no_texts(spark, tmp_path):
    assert an.read_answers(spark, str(tmp_path / "none")).collect() == []
    assert an.answer_open_requests(frame_of(spark), counting(tmp_path), str(tmp_path / "none")) == 0
    assert an.answer_open_requests(spark.createDataFrame([(1, None)], "text_id bigint, tokens array<string>"), counting(tmp_path), str(tmp_path / "none")) == 0


# --- usage of calls ---------------------------------------------------------


def reporting(folder, fails=()):
    """Reports the number of tokens, a cost for lists that begin with ``paid``, and nothing for those with ``mute``."""
    make = counting(folder, fails)

    def build():
        run = make()

        def call(tokens):
            answer = run(tokens)
            if tokens[:1] == ["mute"]:
                return answer
            told = {"prompt_tokens": len(tokens), "completion_tokens": 1, "total_tokens": len(tokens) + 1, "model": "x"}
            return co.Answered(answer, told | {"cost": 0.5} if tokens[:1] == ["paid"] else told)

        return call

    return build


def test_usage_is_that_of_the_calls_of_a_run(spark, tmp_path):
    calls, store = tmp_path / "calls", str(tmp_path / "store")
    calls.mkdir()
    frame = frame_of(spark, ["paid", "b"], ["paid", "b"], ["c"], ["mute"], [], ["bad"], None).repartition(3)
    first = an.call_open_requests(frame, reporting(calls, fails=("bad",)), store)
    assert first == an.CallTotals(calls=5, failed=1, prompt_tokens=3, completion_tokens=3, total_tokens=6, cost=0.5)
    assert len(list(calls.iterdir())) == first.calls
    again = an.call_open_requests(frame, reporting(calls), store)
    assert again == an.CallTotals(calls=1, prompt_tokens=1, completion_tokens=1, total_tokens=2)
    assert an.call_open_requests(frame, reporting(calls), store) == an.CallTotals()
    [kept] = usage.usage_totals(an.read_usage(spark, store)).collect()
    assert tuple(kept) == tuple(x + y for x, y in zip(first[2:], again[2:], strict=True))
    by_key = {r.key: r for r in an.read_usage(spark, store).where("cost IS NULL AND total_tokens IS NULL").collect()}
    assert len(by_key) == 2  # the call that failed and the one that reports nothing


def test_usage_of_a_killed_run_counts_each_answer_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(an, "TASK_REQUESTS", 10)
    calls, store = tmp_path / "calls", str(tmp_path / "store")
    calls.mkdir()
    frame = frame_of(spark, *[[f"t{n}"] * (n % 7) for n in range(1, 200)], ["bad"])
    distinct = {tuple(r.tokens) for r in frame.collect()}
    with pytest.raises(Exception, match="no answer"):
        an.call_open_requests(frame, reporting(calls, fails=("bad",)), store, on_error="raise")
    left = an.open_requests(frame, store).count()
    assert an.call_open_requests(frame, reporting(calls), store).calls == left
    [kept] = usage.usage_totals(an.read_usage(spark, store)).collect()
    assert (kept.prompt_tokens, kept.completion_tokens) == (sum(map(len, distinct)), len(distinct))


def test_a_store_without_usage_and_a_plain_call(spark, tmp_path):
    store = str(tmp_path / "store")
    old = spark.createDataFrame([("k", ["a"], ["A"], None)], "key string, tokens array<string>, answer array<string>, error string")
    old.write.parquet(store)
    assert [tuple(r) for r in an.read_usage(spark, store).collect()] == [("k", None, None, None, None)]
    assert tuple(usage.usage_totals(an.read_usage(spark, str(tmp_path / "none"))).first()) == (0, 0, 0, 0.0)
    rows = co.correct_with(frame_of(spark, ["a", "b"], None), reporting(tmp_path), with_usage=True).orderBy("text_id").collect()
    assert [(r.corrected_tokens, r.error, r.prompt_tokens, r.cost) for r in rows] == [(["A", "B"], None, 2, None), (None, None, None, None)]
    assert co.correct_with(frame_of(spark, ["a"]), reporting(tmp_path)).columns == ["text_id", "tokens", "corrected_tokens", "error"]


def test_rules_of_all_lengths_are_looked_up_together(spark):
    rows = [(1, ["a", "b", "c", "d"]), (1, ["a", "b", "x", "d"]), (None, ["d"]), (2, []), (3, None), (1, ["a", "b", "c", "d"])]
    texts = spark.createDataFrame(rows, "text_id bigint, tokens array<string>")
    rules = [(1, ["d"], ["D"]), (2, ["a", "b"], ["AB"]), (3, ["a", "b", "c"], ["ABC"]), (6, list("abcdef"), ["no"])]
    frame = spark.createDataFrame(rules, "n int, src array<string>, dst array<string>")
    wanted = sorted([(1, "ABC D"), (1, "AB x D"), (None, "D"), (2, ""), (3, None), (1, "ABC D")], key=repr)
    for limits in ({"inline_bytes": 0}, {"inline_bytes": 0, "broadcast_bytes": 0}):
        done = co.rewrite_tokens(texts, Rewrites.from_frame(frame, **limits), "tokens", "out")
        assert sorted(((r.text_id, r.out and " ".join(r.out) if r.out else (None if r.out is None else "")) for r in done.collect()), key=repr) == wanted
        # First tokens (for the rows and for what they ask) and windows, however many lengths the rules have.
        assert done._jdf.queryExecution().optimizedPlan().toString().count("FlatMapCoGroupsInArrow") == 3
