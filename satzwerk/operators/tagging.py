"""Tagging: lemma, word class and tense for every word of a text."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from satzwerk.functions import fixed, text as tx
from satzwerk.operators.lexicon import MIN_STEM, TAG_TYPE, Lexicon
from satzwerk.operators.reference import inline_value, lookup_tokens
from satzwerk.operators.settled import settled
from satzwerk.operators.workers import once_per_worker, worker_key

WORDS_TYPE = "array<struct<word:string,lemma:string,upos:string,tense:string>>"
VERB_CLASSES = ("VERB", "AUX")


def _word(word: Column, lemma: Column, upos: Column | str, tense: Column | str | None) -> Column:
    def column(value: Column | str | None) -> Column:
        return value if isinstance(value, Column) else F.lit(value).cast("string")

    return F.struct(
        word.alias("word"), lemma.alias("lemma"), column(upos).alias("upos"), column(tense).alias("tense")
    )


def _nothing() -> Column:
    return F.lit(None).cast(WORDS_TYPE)


def _by_suffix(token: Column, form: Column, rules: tuple) -> Column:
    """The word by its longest suffix with MIN_STEM letters before it, else NULL.

    One look-up for each length that a suffix has, however many rules there are.
    """
    by_length: dict[int, dict[str, dict]] = {}
    for suffix, ending, upos, tense in rules:
        rule = {"lemma": ending, "upos": upos, "tense": tense}
        by_length.setdefault(len(suffix), {}).setdefault(suffix, rule)
    found = _nothing()
    for length, endings in sorted(by_length.items()):
        rule = inline_value(F.right(form, F.lit(length)), endings, TAG_TYPE)
        stem = F.substring(form, F.lit(1), F.length(form) - length)
        word = _word(token, F.concat(stem, rule["lemma"]), rule["upos"], rule["tense"])
        hit = (F.length(form) >= length + MIN_STEM) & F.right(form, F.lit(length)).isin(*endings)
        found = F.when(hit, F.array(word)).otherwise(found)
    return found


def _contraction(token: Column, form: Column, parts: dict[str, list[dict]]) -> Column:
    """The tagged parts; the first keeps the capital of the token."""
    capital = token.rlike(fixed.CAPITALISED)

    def shown(part: Column, place: Column) -> Column:
        name = part["word"]
        raised = F.concat(
            F.upper(F.substring(name, 1, 1)), F.substring(name, F.lit(2), F.length(name))
        )
        word = F.when((place == 0) & capital, raised).otherwise(name)
        return _word(word, part["lemma"], part["upos"], part["tense"])

    return F.transform(inline_value(form, parts, WORDS_TYPE), shown)


def contraction_words(token: Column, lexicon: Lexicon) -> Column:
    """The words of one token: the parts of a contraction, else the token."""
    if not lexicon.contractions:
        return F.array(token)
    form = tx.casefold(token)
    parts = _contraction(token, form, lexicon.contractions)
    return F.when(
        form.isin(*lexicon.contractions), F.transform(parts, lambda part: part["word"])
    ).otherwise(F.array(token))


def _resolve(
    token: Column, form: Column, listed: Column, tag: Column, before: Column,
    lexicon: Lexicon, verbs_only: bool,
) -> Column:
    """The words of one token. Order of the rules: contraction, listed form,
    mark, noun by its capital, suffix, unknown.

    With ``verbs_only`` everything that is no verb is NULL. That skips most
    tokens early, and it is all that counting and highlighting need.
    """
    contractions, suffixes = lexicon.contractions, lexicon.suffixes
    if verbs_only:
        contractions = {
            key: parts
            for key, parts in contractions.items()
            if any(part["upos"] in VERB_CLASSES for part in parts)
        }
        suffixes = tuple(rule for rule in suffixes if rule[2] in VERB_CLASSES)
    is_listed_word = F.array(_word(token, tag["lemma"], tag["upos"], tag["tense"]))
    # A capital inside a sentence makes an unlisted word a noun.
    is_noun = token.rlike(fixed.CAPITALISED) & ~F.coalesce(before, F.lit(".")).isin(
        *fixed.SENTENCE_OPENERS
    )
    by_suffix = _by_suffix(token, form, suffixes)
    if verbs_only:
        rules = F.when(listed, F.when(tag["upos"].isin(*VERB_CLASSES), is_listed_word))
        if suffixes:
            ending = F.lit(False)
            for suffix in {rule[0] for rule in suffixes}:
                ending |= form.endswith(suffix)
            rules = rules.when(ending & ~is_noun & token.rlike(fixed.HAS_WORD_CHAR), by_suffix)
    else:
        rules = (
            F.when(listed, is_listed_word)
            .when(~token.rlike(fixed.HAS_WORD_CHAR), F.array(_word(token, token, "PUNCT", None)))
            .when(is_noun, F.array(_word(token, token, "NOUN", None)))
            .otherwise(
                F.coalesce(by_suffix, F.array(_word(token, F.lit(None).cast("string"), "X", None)))
            )
        )
    if not contractions:
        return rules.cast(WORDS_TYPE)
    parts = _contraction(token, form, contractions)
    return F.when(form.isin(*contractions), parts).otherwise(rules).cast(WORDS_TYPE)


def tag_tokens(
    frame: DataFrame,
    lexicon: Lexicon | None = None,
    tokens: str = "tokens",
    out: str = "words",
    id_col: str | None = None,
    verbs_only: bool = False,
) -> DataFrame:
    """Add the tagged words of an ARRAY<STRING> column, aligned with it.

    ``id_col`` is not needed: rows may share an id or have none.

    What a token needs of its neighbours is zipped to it: an array reached from
    inside the lambda could be put together anew for every token.
    """
    lexicon = Lexicon.from_rows() if lexicon is None else lexicon
    frame = settled(frame, **{tokens: F.col(tokens)})
    parts = [F.col(tokens).alias("token"), tx.preceding(F.col(tokens)).alias("before")]
    if lexicon.forms.how == "inline":
        rows = lexicon.forms.rows
        parts.append(F.transform(tokens, tx.casefold).alias("form"))

        def words(entry: Column) -> Column:
            form = entry["form"]
            listed = form.isin(*rows) if rows else F.lit(False)
            tag = inline_value(form, rows, TAG_TYPE)
            return _resolve(entry["token"], form, listed, tag, entry["before"], lexicon, verbs_only)
    else:
        frame = settled(frame, _forms=F.transform(tokens, tx.casefold))
        frame = lookup_tokens(frame, "_forms", lexicon.forms, "_tags")
        parts += [F.col("_forms").alias("form"), F.col("_tags").alias("tag")]

        def words(entry: Column) -> Column:
            token, form, tag = entry["token"], entry["form"], entry["tag"]
            return _resolve(token, form, tag.isNotNull(), tag, entry["before"], lexicon, verbs_only)

    tagged = F.transform(F.arrays_zip(*parts), words)
    return settled(frame, **{out: tagged}).drop("_forms", "_tags")


def tag_texts(
    frame: DataFrame,
    lexicon: Lexicon | None = None,
    text: str = "text",
    tokens: str = "tokens",
    out: str = "words",
    id_col: str | None = None,
    verbs_only: bool = False,
) -> DataFrame:
    """Tokenize and tag a STRING column; adds ``tokens`` and ``words``."""
    with_tokens = frame.withColumn(tokens, tx.tokenize(F.col(text)))
    return tag_tokens(with_tokens, lexicon, tokens, out, id_col, verbs_only)


Tagger = Callable[[list[str]], list[list[dict]]]


def tag_with(
    frame: DataFrame,
    make_tagger: Callable[[], Tagger],
    tokens: str = "tokens",
    out: str = "words",
) -> DataFrame:
    """Tag with an external tagger, loaded once per Python worker.

    The tagger gets the tokens of one text and returns, per token, its words as
    dicts with ``word``, ``lemma``, ``upos`` and ``tense``.
    """

    key = worker_key()

    @F.pandas_udf(f"array<{WORDS_TYPE}>")
    def run(texts: pd.Series) -> pd.Series:
        tagger = once_per_worker(make_tagger, key)
        return texts.map(lambda row: None if row is None else tagger(list(row)))

    return frame.withColumn(out, run(F.col(tokens)))


def word_table(frame: DataFrame, words: str = "words", id_col: str = "text_id") -> DataFrame:
    """One row per word: id, tok_id, word_id, word, lemma, upos, tense."""
    # Outer, with a filter on what comes out: the other form puts one on what goes in.
    tokens = frame.select(id_col, F.posexplode_outer(words).alias("tok_id", "_group"))
    words = tokens.select(id_col, "tok_id", F.posexplode_outer("_group").alias("word_id", "_word"))
    return words.where("word_id IS NOT NULL").select(
        id_col,
        F.col("tok_id").cast("bigint").alias("tok_id"),
        F.col("word_id").cast("bigint").alias("word_id"),
        "_word.*",
    )
