"""Text functions and tokens: T1 to T11 and A7, against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from satzwerk.functions import text as tx
from satzwerk.operators import tokens as tk

WORD = r"[\w]"
ALPHABET = list("abÄöß éŁ09_-.,;:!?\"'()[]{}<&\t\n\r „“😀²")


def texts(seed, count=300, size=40):
    chosen = random.Random(seed)
    return ["".join(chosen.choices(ALPHABET, k=chosen.randint(0, size))) for _ in range(count)]


def applied(spark, values, function, kind="string"):
    frame = spark.createDataFrame(list(enumerate(values)), f"n int, x {kind}")
    return [r.y for r in frame.select("n", function(F.col("x")).alias("y")).orderBy("n").collect()]


def cleaned(text):
    text = re.sub(r"\s+", " ", text).strip()
    return re.sub(r"[^\w\s.,!?äöüÄÖÜß-]", "", text)


def tokens(text):
    return re.findall(r"\w+(?:-\w+)*|[^\w\s]", text)


def quoted(text):
    out, opening = [], True
    for char in text:
        if char == '"':
            char, opening = ("„" if opening else '"'), not opening
        out.append(char)
    return "".join(out)


@pytest.mark.parametrize(
    "spark_side, plain",
    [
        (tx.clean_text, cleaned),
        (tx.flatten_text, lambda t: t.replace("\n", " ").strip()),
        (tx.tokenize, tokens),
        (tx.german_quotes, quoted),
        (tx.casefold, str.casefold),
        (lambda c: tx.word_count(tx.tokenize(c)), lambda t: sum(not all(x in ".,!?;:\"'()[]{}" for x in w) for w in tokens(t))),
        (lambda c: tx.word_count(F.lit(None).cast("array<string>")), lambda t: 0),
    ],
    ids=["clean", "flatten", "tokenize", "quotes", "casefold", "word_count", "no_tokens"],
)
def test_against_plain_python(spark, spark_side, plain):
    values = texts(1)
    assert applied(spark, values, spark_side) == [plain(v) for v in values]


@pytest.mark.parametrize(
    "text, expected",
    [("a 😀 b", "a  b"), ("hi 😀", "hi "), ('x² „y"', "x² y"), (None, None), ("", "")],
)
def test_clean_text_keeps_what_stood_around_a_symbol(spark, text, expected):
    assert applied(spark, [text], tx.clean_text) == [expected]


@pytest.mark.parametrize(
    "text, expected",
    [
        ('Er sagte: "Hallo"', 'Er sagte: „Hallo"'),
        ('"Ja" und "Nein"', '„Ja" und „Nein"'),
        ("Kein Zitat", "Kein Zitat"),
        ('"', "„"),
        ('""', '„"'),
        ('"a\n', "„a\n"),
        ('"a"b"', '„a"b„'),
    ],
)
def test_german_quotes(spark, text, expected):
    assert applied(spark, [text], tx.german_quotes) == [expected]


def test_tokens_of_a_sentence(spark):
    assert applied(spark, ["Der Hunt läufd im Parc."], tx.tokenize) == [["Der", "Hunt", "läufd", "im", "Parc", "."]]


def test_long_hyphen_chains_are_one_token(spark):
    chain = "-".join(["ab"] * 100_000)
    [found] = applied(spark, [chain + "- x"], tx.tokenize)
    assert found == [chain, "-", "x"]
    assert applied(spark, [chain], lambda c: tx.word_count(tx.tokenize(c))) == [1]


def test_word_count_of_marks(spark):
    assert applied(spark, [["Ja", "...", "-", "„", "?!"]], tx.word_count, "array<string>") == [3]


@pytest.mark.parametrize(
    "words, expected",
    [
        (["Ja", ",", "gut", "."], "Ja, gut."),
        (["Er", "sagt", '"', "Ja", ".", '"'], 'Er sagt "Ja."'),
        (["(", "so", ")", "!"], "(so)!"),
        ([], ""),
    ],
)
def test_detokenize(spark, words, expected):
    assert applied(spark, [words], tx.detokenize, "array<string>") == [expected]


@pytest.mark.parametrize("number, label", [(3, "+3"), (0, "0"), (-2, "-2")])
def test_format_diff(spark, number, label):
    assert applied(spark, [number], tx.format_diff, "bigint") == [label]


def test_offsets_slice_back_to_their_tokens(spark):
    values = texts(2, 100)
    frame = spark.createDataFrame(list(enumerate(values)), "text_id bigint, text string")
    for row in tk.token_offsets(frame).collect():
        assert values[row.text_id][row.start_char : row.end_char] == row.token


def test_sentence_numbers_and_places(spark):
    frame = spark.createDataFrame([(7, "Ja! Er kam. Gut"), (8, None), (9, "")], "text_id bigint, text string")
    found = tk.token_offsets(frame).orderBy("tok_id").collect()
    assert [(r.text_id, r.token, r.sent_id, r.tok_in_sent) for r in found] == [
        (7, "Ja", 0, 0), (7, "!", 0, 1), (7, "Er", 1, 0), (7, "kam", 1, 1), (7, ".", 1, 2), (7, "Gut", 2, 0),
    ]
    assert [r.n_tokens for r in tk.sentence_table(frame).orderBy("sent_id").collect()] == [2, 3, 1]


def test_contractions_become_words(spark):
    frame = spark.createDataFrame([(1, "Zum Park")], "text_id bigint, text string")
    assert [r.word for r in tk.expand_contractions(frame).orderBy("tok_id", "word_id").collect()] == ["Zu", "dem", "Park"]
