"""Functions over tagged words: column in, column out.

Tagging gives a column ``words`` aligned with ``tokens``: one array of words
per token, since a contraction holds several::

    tokens ARRAY<STRING>
    words  ARRAY<ARRAY<STRUCT<word, lemma, upos, tense>>>

An entry may be NULL where a token holds no verb. Counts run over words,
highlights over tokens: a token with two verbs counts twice and is marked once.
Every function works on one row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, functions as F

from satzwerk.functions import fixed, text as tx


def qualifies(include_aux: bool, exclude: Iterable[str] | None) -> Callable[[Column], Column]:
    """Test of one word. The word and its lemma are folded, the set is not."""
    excluded = sorted(set(exclude or ()))

    def test(word: Column) -> Column:
        upos = word["upos"]
        wanted = upos.isin("VERB", "AUX") if include_aux else upos == "VERB"
        if excluded:
            lemma = tx.casefold(F.coalesce(word["lemma"], F.lit("")))
            wanted &= ~tx.casefold(word["word"]).isin(*excluded) & ~lemma.isin(*excluded)
        return wanted

    return test


def verbs(words: Column, include_aux: bool = False, exclude: Iterable[str] | None = None) -> Column:
    """The matching words in document order."""
    listed = F.flatten(F.filter(words, lambda group: group.isNotNull()))
    return F.filter(listed, qualifies(include_aux, exclude))


def size_of(array: Column) -> Column:
    return F.coalesce(F.array_size(array), F.lit(0)).cast("bigint")


def verb_count(
    words: Column, include_aux: bool = False, exclude: Iterable[str] | None = None
) -> Column:
    return size_of(verbs(words, include_aux, exclude))


def of_class(found: Column, upos: str) -> Column:
    """How many of the found words have the class ``upos``."""
    return size_of(F.filter(found, lambda word: word["upos"] == upos))


def of_tense(found: Column, tense: str) -> Column:
    return size_of(F.filter(found, lambda word: word["tense"] == tense))


def tense_counts(found: Column) -> Column:
    """STRUCT<pres, past, verb> of found words; ``verb`` holds all of them."""
    return F.struct(
        of_tense(found, "Pres").alias("pres"),
        of_tense(found, "Past").alias("past"),
        size_of(found).alias("verb"),
    )


def tense_counts_text(counts: Column) -> Column:
    return F.format_string(
        fixed.TENSE_COUNTS_FORMAT, counts["pres"], counts["past"], counts["verb"]
    )


def _span(upos: Column, inner: Column) -> Column:
    def opening(colour: str) -> Column:
        return F.lit(fixed.HIGHLIGHT_OPEN.format(colour=colour))

    start = F.when(upos == "VERB", opening(fixed.VERB_COLOUR)).otherwise(opening(fixed.AUX_COLOUR))
    return F.concat(start, inner, F.lit(fixed.HIGHLIGHT_CLOSE))


def _rebuild(text: Column, marked: Column, between: Callable[[Column], Column]) -> Column:
    """The source text with ``marked`` in place of its tokens."""
    parts = F.zip_with(
        tx.gaps(text),
        marked,
        lambda gap, token: F.concat(between(gap), F.coalesce(token, F.lit(""))),
    )
    return F.array_join(parts, "")


def highlight_verbs(
    text: Column,
    tokens: Column,
    words: Column,
    include_aux: bool = True,
    exclude: Iterable[str] | None = None,
    escape: bool = False,
) -> Column:
    """The text with each verb token in a coloured span; the first verb word decides."""
    test = qualifies(include_aux, exclude)

    def mark(token: Column, group: Column) -> Column:
        inner = tx.escape_html(token) if escape else token
        first = F.get(F.filter(group, test), F.lit(0))["upos"]
        return F.when(F.exists(group, test), _span(first, inner)).otherwise(inner)

    return _rebuild(text, F.zip_with(tokens, words, mark), lambda gap: gap)


def highlight_words(
    words: Column, include_aux: bool = True, exclude: Iterable[str] | None = None
) -> Column:
    """For tokens without a source text: all words, joined by one space.

    Needs the words of every token, not of the verbs alone.
    """
    test = qualifies(include_aux, exclude)
    spans = F.transform(
        F.flatten(words),
        lambda word: F.when(test(word), _span(word["upos"], word["word"])).otherwise(word["word"]),
    )
    return F.array_join(spans, " ")


def tense_markup(text: Column, tokens: Column, words: Column) -> Column:
    """The text as minified entity markup, one label and colour per verb tense.

    Text is escaped, line feeds are breaks, and runs of four spaces vanish.
    """
    test = qualifies(True, None)

    def entity(label: str, inner: Column) -> Column:
        opening = fixed.MARK_OPEN.format(colour=fixed.TENSE_COLOURS[label])
        return F.concat(F.lit(opening), inner, F.lit(fixed.MARK_LABEL.format(label=label)))

    def mark(token: Column, group: Column) -> Column:
        inner = tx.escape_html(token)
        tense = F.get(F.filter(group, test), F.lit(0))["tense"]
        marked = (
            F.when(tense == "Pres", entity("PRES", inner))
            .when(tense == "Past", entity("PAST", inner))
            .otherwise(entity("VERB", inner))
        )
        return F.when(F.exists(group, test), marked).otherwise(inner)

    def between(gap: Column) -> Column:
        return F.replace(gap, F.lit("\n"), F.lit("<br>"))

    content = _rebuild(text, F.zip_with(tokens, words, mark), between)
    whole = F.concat(F.lit(fixed.MARKUP_OPEN), content, F.lit(fixed.MARKUP_CLOSE))
    return F.replace(whole, F.lit("    "), F.lit(""))
