"""Tagging, counting, highlighting, plans: P1 to P9, A1 to A9."""

import re

import pytest
from pyspark.sql import functions as F

from satzwerk.functions import tags
from satzwerk.operators.lexicon import LEXICON_SCHEMA, Lexicon, seed_lexicon_rows
from satzwerk.operators.tagging import tag_texts, tag_with, word_table
from satzwerk.plans import metrics as plans

GOLDEN = [
    (0, "Er baute es auf. Er hat es aufgebaut.", ["bauen", "aufbauen"]),
    (1, "Der Hund läuft im Park. Er spielt mit einem Ball und bringt ihn zurück.", ["laufen", "spielen", "bringen"]),
    (2, "Der große Hund.", []),
    (3, None, []),
    (4, "", []),
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([row[:2] for row in GOLDEN], "text_id bigint, text string")


def test_verb_counts_and_lemmas(texts):
    tagged = tag_texts(texts).select("text_id", tags.verbs(F.col("words")).alias("v"), tags.verb_count(F.col("words")).alias("n"))
    for row, (_, _, lemmas) in zip(tagged.orderBy("text_id").collect(), GOLDEN, strict=True):
        assert row.n == len(lemmas) and [v.lemma for v in row.v or []] == lemmas


def test_auxiliaries_count_on_request(texts):
    [row] = tag_texts(texts).where("text_id = 0").select(tags.verb_count(F.col("words"), include_aux=True).alias("n")).collect()
    assert row.n == 3


@pytest.mark.parametrize("excluded, left", [({"heißen"}, 1), ({"heissen"}, 0), ({"heisst"}, 0), (set(), 1)])
def test_exclusion_compares_folded_words(spark, excluded, left):
    frame = spark.createDataFrame([(0, "Er heißt so.")], "text_id bigint, text string")
    [row] = tag_texts(frame).select(tags.verb_count(F.col("words"), exclude=excluded).alias("n")).collect()
    assert row.n == left


def test_highlight_marks_verbs_and_keeps_the_text(spark):
    text = "Er  hat es\n<schnell> aufgebaut."
    frame = spark.createDataFrame([(0, text)], "text_id bigint, text string")
    [row] = tag_texts(frame).select(
        tags.highlight_verbs(F.col("text"), F.col("tokens"), F.col("words")).alias("all"),
        tags.highlight_verbs(F.col("text"), F.col("tokens"), F.col("words"), include_aux=False).alias("main"),
    ).collect()
    assert re.sub(r"</?span[^>]*>", "", row.all) == text
    assert row.all.count("#0066cc") == 1 and row.all.count("#ff8c00") == 1
    assert row.main.count("<span") == 1


def test_tense_counts(spark):
    frame = spark.createDataFrame([(0, "Er baute es auf und hat es aufgebaut.")], "text_id bigint, text string")
    [row] = tag_texts(frame).select(tags.tense_counts(tags.verbs(F.col("words"), include_aux=True)).alias("c")).collect()
    assert tuple(row.c) == (1, 1, 3)


def test_word_table_has_every_word_once(spark, texts):
    rows = word_table(tag_texts(texts)).where("text_id = 1").orderBy("tok_id", "word_id").collect()
    assert " ".join(r.word for r in rows) == "Der Hund läuft in dem Park . Er spielt mit einem Ball und bringt ihn zurück ."
    assert word_table(tag_texts(texts)).where("text_id > 2").count() == 0


def test_lookups_agree(spark, texts):
    table = spark.createDataFrame(seed_lexicon_rows(), LEXICON_SCHEMA)
    found = [
        sorted(map(tuple, word_table(tag_texts(texts, Lexicon.from_frame(table, **limits))).collect()))
        for limits in ({}, {"inline_bytes": 0}, {"inline_bytes": 0, "broadcast_bytes": 0})
    ]
    assert found[0] == found[1] == found[2] and len(found[0]) > 20


def test_a_large_table_is_not_broadcast(spark, texts):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        table = spark.createDataFrame(seed_lexicon_rows(), LEXICON_SCHEMA)
        lexicon = Lexicon.from_frame(table, inline_bytes=0, broadcast_bytes=0)
        plan = tag_texts(texts, lexicon)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert "SortMergeJoin" in plan


def test_a_thousand_suffix_rules(spark):
    rules = [("suffix", f"e{i:03d}t", f"e{i:03d}n", "VERB", "Pres", 1) for i in range(1000)]
    lexicon = Lexicon.from_rows([*seed_lexicon_rows(), *rules])
    frame = spark.createDataFrame([(0, "Er made007t und made999t, e007t.")], "text_id bigint, text string")
    [row] = tag_texts(frame, lexicon).select(tags.verbs(F.col("words")).alias("v")).collect()
    assert [v.lemma for v in row.v] == ["made007n", "made999n"]


def test_a_large_lexicon_from_rows_is_joined(spark):
    rows = [("form", f"wort{i:06d}" + "x" * 40, "w", "VERB", None, 1) for i in range(25_000)]
    lexicon = Lexicon.from_rows(rows, contractions={})
    assert lexicon.forms.how == "broadcast"
    frame = spark.createDataFrame([(0, f"Er {rows[7][1]}.")], "text_id bigint, text string")
    [row] = tag_texts(frame, lexicon).select(tags.verb_count(F.col("words")).alias("n")).collect()
    assert row.n == 1


def repeated_extractions(frame):
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    inside = re.findall(r"lambdafunction\((?:[^()]|\([^()]*\))*regexp_extract_all", plan)
    return plan.count("regexp_extract_all"), len(inside)


@pytest.mark.parametrize("limit", [None, 3])
def test_filters_do_not_tokenize_again(spark, texts, tmp_path, limit):
    texts.write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    counted = tag_texts(stored, verbs_only=True).withColumn("n", tags.verb_count(F.col("words")))
    words = word_table(tag_texts(stored))
    measured = plans.text_metrics(stored)
    if limit is not None:
        counted, measured = counted.where(f"n > {limit}"), measured.where(f"total_verbs > {limit}")
        words = words.where("upos = 'VERB'")
    for frame in (counted, words, measured):
        total, inside = repeated_extractions(frame)
        assert total <= 3 and inside == 0


def test_external_tagger_is_built_once_per_worker(spark, tmp_path):
    built = tmp_path / "built"
    built.mkdir()

    def make():
        import os
        import tempfile

        tempfile.mkstemp(dir=built, prefix=f"{os.getpid()}-")
        return lambda tokens: [[{"word": t, "lemma": t, "upos": "VERB", "tense": None}] for t in tokens]

    frame = spark.range(0, 400, numPartitions=16).select(F.array(F.lit("a"), F.lit("b")).alias("tokens"))
    rows = tag_with(frame, make).select(tags.verb_count(F.col("words")).alias("n")).collect()
    assert {r.n for r in rows} == {2}
    # Spark may start a new worker after an idle one has ended, but none builds twice.
    workers = [path.name.split("-")[0] for path in built.iterdir()]
    assert workers and len(workers) == len(set(workers))


def test_text_metrics_and_comparison(spark):
    versions = spark.createDataFrame(
        [("g", 1, "a", "Er baute."), ("g", 2, "b", ""), ("g", 3, "c", "Er hat gebaut und spielt."), ("h", 1, "x", "Ja.")],
        "group_id string, version_no int, name string, text string",
    ).withColumn("text_id", F.monotonically_increasing_id())
    measured = plans.text_metrics(versions)
    rows = {r.name: r for r in measured.collect()}
    assert (rows["a"].total_words, rows["a"].total_verbs, rows["a"].main_verbs, rows["a"].aux_verbs) == (2, 1, 1, 0)
    assert (rows["c"].total_words, rows["c"].main_verbs, rows["c"].aux_verbs) == (5, 2, 1)
    assert all(r.total_verbs == r.main_verbs + r.aux_verbs for r in rows.values())
    [diff] = plans.compare_first_last(measured).collect()
    assert (diff.group_id, diff.diff_total_words, diff.label_total_words, diff.label_main_verbs) == ("g", 3, "+3", "+1")
    long = plans.metrics_long(measured).where("name = 'c'").collect()
    assert {(r.metric, r.value) for r in long} == {("Total Words", 5), ("Total Verbs", 3), ("Main Verbs", 2), ("Auxiliaries", 1)}


def test_process_texts_in_order(spark):
    rows = plans.process_texts(spark, ["Er spielt.", "", "Er baute. Er lief."]).collect()
    assert [(r.text_id, r.verb_count) for r in rows] == [(0, 1), (1, 0), (2, 2)]


def test_tense_pairs(spark):
    pairs = spark.createDataFrame([(0, "Er baut 😀.", "Er baute.")], "row_idx bigint, original string, corrected string")
    assert tuple(plans.original_vs_corrected(pairs).first()) == (0, 1, 0, 1, 0, 1, 1)
