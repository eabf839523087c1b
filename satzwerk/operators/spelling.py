"""Misspellings that no list holds: suggestions from the corpus's own vocabulary.

A word that is rare in the corpus is compared with the frequent ones through an
index of deletions (Garbe 2012): both words and what is left of them without one
letter, or two for long words, are keys of an equi-join, so only pairs that share
such a form are ever looked at, and each is verified by its edit distance. The
index has a row for each word and deletion, not for each place in the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from satzwerk.functions import fixed, text as tx
from satzwerk.operators.lexicon import Rewrites

#: Shorter words get no suggestion; from the second length on two letters may differ.
SHORTEST, TWO_FROM = 4, 8


def vocabulary(frame: DataFrame, text: str = "text") -> DataFrame:
    """word and n: how often each token of letters alone stands in the texts."""
    words = frame.select(F.explode(tx.tokenize(F.col(text))).alias("word"))
    return words.where(F.col("word").rlike(fixed.LETTERS_ONLY)).groupBy("word").agg(F.count("*").alias("n"))


def _without_one(word: Column) -> Column:
    """All strings that lack one letter of the word, each once."""
    places = F.sequence(F.lit(1), F.length(word))
    return F.array_distinct(
        F.transform(places, lambda p: F.concat(F.substring(word, F.lit(1), p - 1), F.substring(word, p + 1, F.length(word))))
    )


def _forms(word: Column, two: Column | None) -> Column:
    """The word and its deletions: of one letter, and of two where ``two`` holds."""
    one = _without_one(word)
    forms = F.concat(F.array(word), one)
    if two is None:
        return forms
    further = F.array_distinct(F.flatten(F.transform(one, _without_one)))
    return F.when(two, F.array_distinct(F.concat(forms, further))).otherwise(forms)


def suggestions(words: DataFrame, rare: int = 1, frequent: int = 10, two_from: int | None = TWO_FROM) -> DataFrame:
    """word, n, suggestion, suggestion_n, distance for each rare word that has a suggestion.

    ``words`` has word and n, each word once. Words of at most ``rare`` occurrences are
    compared with those of at least ``frequent``. One letter may be changed, added or
    left out; in words of ``two_from`` letters or more, two (None: never). The nearest
    word counts, of equally near ones the most frequent, then the first by its bytes.
    Words under ``SHORTEST`` letters and NULL words have no suggestion.
    """
    if rare >= frequent:
        raise ValueError("rare words have to be less frequent than frequent ones")
    length = F.length("word")
    # A frequent word within two letters of a long rare one may be two letters shorter.
    two = None if two_from is None else length >= two_from
    two_known = None if two_from is None else length >= two_from - 2
    unknown = words.where((F.col("n") <= rare) & (length >= SHORTEST))
    known = words.where((F.col("n") >= frequent) & (length >= SHORTEST - 1))
    asked = unknown.select("word", "n", F.explode(_forms(F.col("word"), two)).alias("form"))
    offered = known.select(
        F.col("word").alias("suggestion"), F.col("n").alias("suggestion_n"), F.explode(_forms(F.col("word"), two_known)).alias("form")
    )
    allowed = F.lit(1) if two is None else F.when(two, 2).otherwise(1)
    pairs = asked.join(offered, "form").withColumn("distance", F.levenshtein("word", "suggestion").cast("bigint"))
    # The order in one number and one string keeps the aggregate hashed and combined before the shuffle.
    near = pairs.where(F.col("distance") <= allowed).select(
        "word", "n", "suggestion", "suggestion_n", "distance", (F.col("distance") * F.lit(2**60) - F.col("suggestion_n")).alias("_order")
    )
    best = near.groupBy("word").agg(F.min("_order").alias("_order"))
    first = near.join(best, ["word", "_order"]).groupBy("word", "n", "suggestion_n", "distance").agg(F.min("suggestion").alias("suggestion"))
    return first.select("word", "n", "suggestion", "suggestion_n", "distance")


def as_rewrites(found: DataFrame, **limits: int) -> Rewrites:
    """Suggestions as rules for correct_tokens and correct_spelling."""
    rules = found.select(F.lit(1).alias("n"), F.array("word").alias("src"), F.array("suggestion").alias("dst"))
    return Rewrites.from_frame(rules, **limits)
