"""Text and token functions: column in, column out.

All of them are built-in expressions over one row, so they add no shuffle and
also work on a streaming frame. A NULL text gives NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from satzwerk.functions import fixed


def clean_text(text: Column) -> Column:
    """Collapse white space, strip, then drop marks and symbols.

    White space is handled first, so a symbol between two spaces leaves both.
    """
    collapsed = F.trim(F.regexp_replace(text, fixed.SPACE_RUN, " "))
    return F.regexp_replace(collapsed, fixed.UNWANTED, "")


def strip(text: Column) -> Column:
    """Remove all Unicode white space at both ends."""
    return F.trim(text, F.lit(fixed.SPACES))


def flatten_text(text: Column) -> Column:
    """Line feeds become spaces, the ends are stripped, nothing else changes."""
    return strip(F.replace(text, F.lit("\n"), F.lit(" ")))


def universal_newlines(text: Column) -> Column:
    """CRLF and lone CR become LF."""
    unified = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    return F.replace(unified, F.lit("\r"), F.lit("\n"))


def casefold(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def tokenize(text: Column) -> Column:
    """Words and single marks as ARRAY<STRING>, in text order."""
    return F.regexp_extract_all(text, F.lit(fixed.TOKEN), F.lit(0))


def gaps(text: Column) -> Column:
    """The white space around the tokens: one entry before each, one after the last."""
    return F.split(text, fixed.TOKEN, -1)


def sentences(text: Column) -> Column:
    """The text cut after each run of full stops, exclamation or question marks."""
    return F.regexp_extract_all(text, F.lit(fixed.SENTENCE), F.lit(0))


def word_count(tokens: Column) -> Column:
    """Tokens that are more than punctuation; NULL counts as none."""
    words = F.filter(tokens, lambda token: token.rlike(fixed.NOT_PUNCTUATION))
    return F.coalesce(F.array_size(words), F.lit(0)).cast("bigint")


def preceding(tokens: Column) -> Column:
    """The same array moved one place on: NULL first, the last token dropped."""
    head = F.slice(tokens, F.lit(1), F.greatest(F.array_size(tokens) - 1, F.lit(0)))
    moved = F.concat(F.array(F.lit(None).cast("string")), head)
    return F.when(F.array_size(tokens) == 0, tokens).otherwise(moved)


def following(tokens: Column) -> Column:
    """The same array moved one place back; one entry shorter."""
    return F.slice(tokens, F.lit(2), F.greatest(F.array_size(tokens), F.lit(1)))


def detokenize(tokens: Column) -> Column:
    """Join tokens by German spacing rules."""
    text = F.array_join(tokens, " ")
    for pattern, replacement in fixed.DETOKENIZE_RULES:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def german_quotes(text: Column) -> Column:
    """Every odd ASCII quote becomes the low opening mark; even ones stay."""
    return F.regexp_replace(text, fixed.ASCII_QUOTED, fixed.OPENING_QUOTE + "$1$2")


def escape_html(text: Column) -> Column:
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(mark), F.lit(entity))
    return text


def format_diff(number: Column) -> Column:
    """``+n`` above zero, the plain number otherwise."""
    digits = number.cast("string")
    return F.when(number > 0, F.concat(F.lit("+"), digits)).otherwise(digits)


def cost_info(cost: Column, total: Column, prompt: Column, completion: Column) -> Column:
    """The usage line; a part appears only above zero, so it may be empty."""
    return F.concat_ws(
        fixed.INFO_SEPARATOR,
        F.when(cost > 0, F.format_string(fixed.COST_FORMAT, cost)),
        F.when(total > 0, F.format_string(fixed.USAGE_FORMAT, total, prompt, completion)),
    )
