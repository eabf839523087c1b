"""Correction: C1 to C9."""

import random

import pytest
from pyspark.sql import functions as F

from satzwerk.functions import fixed
from satzwerk.operators import correction as co, usage as us
from satzwerk.operators.lexicon import Rewrites, examples_frame

SENTENCE = ["Der", "Hunt", "läufd", "im", "Parc", "."]


def frame_of(spark, *lists):
    return spark.createDataFrame(list(enumerate(lists)), "text_id bigint, tokens array<string>")


def corrected(frame, **options):
    return [r.corrected_tokens for r in co.correct_tokens(frame, **options).orderBy("text_id").collect()]


def test_rewrites_merges_capitals_and_period(spark):
    rules = Rewrites.from_rows([(["b", "c"], ["bc"]), (["x"], ["y", "z"]), (["b"], ["never"])])
    found = corrected(frame_of(spark, ["a", "b", "c", "x"], ["b", "b", "c", "."], [], None), rewrites=rules)
    assert found == [["A", "bc", "y", "z", "."], ["Never", "bc", "."], [], None]


def test_merges_do_not_overlap(spark):
    rules = Rewrites.from_rows([([",", ","], ['"'])])
    found = corrected(frame_of(spark, [",", ",", ",", ",", ","]), rewrites=rules, add_period=False)
    assert found == [['"', '"', ","]]


def plainly_rewritten(tokens, rules):
    out, at = [], 0
    while at < len(tokens):
        n = max((n for n in range(1, 8) if tuple(tokens[at : at + n]) in rules), default=0)
        out += rules[tuple(tokens[at : at + n])] if n else tokens[at : at + 1]
        at += n or 1
    return out


def test_rules_of_any_length_in_every_lookup(spark):
    chosen = random.Random(4)
    rules = {}
    for n in (1, 2, 3, 4, 6):
        for _ in range(9 * n):
            rules[tuple(chosen.choices("abc-A0", k=n))] = chosen.choices(["x", "y", "0", "z z"], k=chosen.randint(0, 4))
    lists = [chosen.choices("abc-A0d", k=chosen.randint(0, 30)) for _ in range(300)] + [[], ["a"]]
    frame = frame_of(spark, *lists, None)
    table = spark.createDataFrame([(len(k), list(k), v) for k, v in rules.items()], "n int, src array<string>, dst array<string>")
    ways = [Rewrites.from_rows([(list(k), v) for k, v in rules.items()])]
    ways += [Rewrites.from_frame(table, **limits) for limits in ({"inline_bytes": 0}, {"inline_bytes": 0, "broadcast_bytes": 0})]
    for way in ways:
        found = {r.text_id: r.out for r in co.rewrite_tokens(frame, way, "tokens", "out").collect()}
        assert [found[n] for n in range(len(lists))] == [plainly_rewritten(tokens, rules) for tokens in lists]
        assert found[len(lists)] is None


def test_a_rule_without_tokens_is_refused():
    with pytest.raises(ValueError, match="needs a token"):
        Rewrites.from_rows([([], ["x"])])


@pytest.mark.parametrize("word, expected", [("école", "École"), ("ørsted", "Ørsted"), ("ßa", "ßa"), ("über", "Über"), ("1a", "1a")])
def test_capitals_of_any_letter(spark, word, expected):
    assert corrected(frame_of(spark, [word, "."])) == [[expected, "."]]


@pytest.mark.parametrize("source", ["Der Hunt läufd im Parc.", SENTENCE])
def test_identity_backend_on_text_and_tokens(spark, source):
    kind = "string" if isinstance(source, str) else "array<string>"
    frame = spark.createDataFrame([(0, source)], f"text_id bigint, x {kind}")
    [row] = co.correct_spelling(frame, co.identity_corrector, "x").collect()
    assert row.corrected == "Der Hunt läufd im Parc." and row.error is None


def test_a_failing_backend_is_told_apart(spark):
    def make():
        def run(tokens):
            if tokens[0] == "no":
                raise ValueError("bad")
            return tokens

        return run

    frame = frame_of(spark, ["ja"], ["no"], None)
    rows = co.correct_with(frame, make).orderBy("text_id").collect()
    assert [(r.corrected_tokens, r.error) for r in rows] == [(["ja"], None), (None, "ValueError: bad"), (None, None)]
    with pytest.raises(Exception, match="bad"):
        co.correct_with(frame, make, on_error="raise").collect()


def test_one_call_for_each_request_and_none_while_planning(spark, tmp_path):
    calls, built = tmp_path / "calls", tmp_path / "built"
    calls.mkdir()
    built.mkdir()

    def make():
        import os
        import tempfile

        tempfile.mkstemp(dir=built, prefix=f"{os.getpid()}-")

        def run(tokens):
            tempfile.mkstemp(dir=calls)
            return [*tokens, "!"]

        return run

    lists = [["a", str(n % 7)] for n in range(200)] + [None, None]
    frame = frame_of(spark, *lists).repartition(8)
    planned = co.correct_distinct(frame, make)
    assert not list(calls.iterdir())
    rows = planned.collect()
    assert len(rows) == 202 and len(list(calls.iterdir())) == 7
    assert all(r.corrected_tokens == (None if r.tokens is None else [*r.tokens, "!"]) for r in rows)
    workers = [path.name.split("-")[0] for path in built.iterdir()]
    assert len(workers) == len(set(workers))

    kept = co.correct_distinct(frame, make, answers_path=str(tmp_path / "answers"))
    kept.collect(), kept.count()
    assert len(list(calls.iterdir())) == 14


def test_whole_texts(spark):
    frame = spark.createDataFrame([(0, "a"), (1, None)], "text_id bigint, text string")
    rows = co.correct_whole_text(frame, lambda: str.upper).orderBy("text_id").collect()
    assert [r.corrected for r in rows] == ["A", None]


def test_distinct_requests(spark):
    rows = co.distinct_requests(frame_of(spark, ["a"], ["a"], ["b"], None)).collect()
    assert sorted((r.tokens, r.n_texts) for r in rows) == [(["a"], 2), (["b"], 1)]


def test_audit(spark):
    frame = spark.createDataFrame([(["a", "b", "c"], ["a", "x"])], "b array<string>, a array<string>")
    [row] = frame.select(co.correction_audit(F.col("b"), F.col("a")).alias("x")).collect()
    assert row.x.asDict() == {
        "n_before": 3, "n_after": 2, "n_changed": 2, "n_deleted": 2, "n_inserted": 1, "flag_shorter": True, "flag_deleted": True,
    }


def test_worked_examples(spark):
    rows = examples_frame(spark).orderBy("ex_id").collect()
    assert [(len(r.tokens), len(r.corrected)) for r in rows] == [(20, 21), (14, 15), (14, 14), (7, 7), (14, 13), (54, 55)]
    assert len(fixed.WORKED_PAIRS) == 6


@pytest.mark.parametrize(
    "rows, total, info",
    [
        ([(1, 2, 3, None), (4, 5, 9, 0.0), (None, None, None, 0.25)], (5, 7, 12, 0.25),
         "Total Cost for Correction with LLM: $0.250000 | Total Tokens: 12 (prompt: 5, completion: 7)"),
        ([], (0, 0, 0, 0.0), ""),
        ([(1, 1, 2, None)], (1, 1, 2, 0.0), "Total Tokens: 2 (prompt: 1, completion: 1)"),
    ],
)
def test_usage(spark, rows, total, info):
    frame = spark.createDataFrame(rows, "prompt_tokens bigint, completion_tokens bigint, total_tokens bigint, cost double")
    assert tuple(us.usage_totals(frame).first()) == total
    assert us.cost_info(frame).first().info == info


def test_spelling_makes_a_text_with_german_quotes(spark):
    frame = spark.createDataFrame([(0, 'er sagt "Ja"')], "text_id bigint, text string")
    assert co.correct_spelling(frame).first().corrected == 'Er sagt „Ja"'
