"""Token, sentence and word tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from satzwerk.functions import fixed, tags, text as tx
from satzwerk.operators.lexicon import Lexicon
from satzwerk.operators.settled import settled
from satzwerk.operators.tagging import contraction_words

SPANS_TYPE = "array<struct<sent_id:bigint,tok_in_sent:bigint,start_char:bigint,end_char:bigint>>"


def token_table(frame: DataFrame, text: str = "text", id_col: str = "text_id") -> DataFrame:
    """One row per token: id, tok_id, token. No shuffle."""
    tokens = frame.select(id_col, F.posexplode(tx.tokenize(F.col(text))).alias("tok_id", "token"))
    return tokens.withColumn("tok_id", F.col("tok_id").cast("bigint"))


def sentence_table(frame: DataFrame, text: str = "text", id_col: str = "text_id") -> DataFrame:
    """One row per sentence: id, sent_id, tokens, n_tokens. No shuffle.

    A piece of white space only is no sentence, so it takes no number.
    """
    lists = F.filter(
        F.transform(tx.sentences(F.col(text)), tx.tokenize), lambda tokens: F.array_size(tokens) > 0
    )
    found = frame.select(id_col, F.posexplode(lists).alias("sent_id", "tokens"))
    return found.select(
        id_col,
        F.col("sent_id").cast("bigint").alias("sent_id"),
        "tokens",
        tags.size_of(F.col("tokens")).alias("n_tokens"),
    )


def token_offsets(frame: DataFrame, text: str = "text", id_col: str = "text_id") -> DataFrame:
    """One row per token with its sentence and its span in the text.

    Columns: id, tok_id, sent_id, tok_in_sent, token, start_char, end_char (the
    end is exclusive). A text whose id stands once is summed up as it is, in Arrow
    batches. Rows that share an id are one text, whose tokens are sorted.
    """
    texts = frame.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"))
    shared = frame.groupBy(F.col(id_col).alias("_shared")).agg(F.count("*").alias("_n")).where("_n > 1").select("_shared")
    same = F.col("_id").eqNullSafe(F.col("_shared"))
    once = _offsets_once(texts.join(shared, same, "left_anti"))
    together = _offsets_together(texts.join(shared, same, "left_semi"), "_id")
    return once.unionByName(together).withColumnRenamed("_id", id_col)


def _offsets_once(texts: DataFrame) -> DataFrame:
    """The token offsets of texts, each by itself."""

    @F.arrow_udf(SPANS_TYPE)
    def spans(gaps: pa.Array, sizes: pa.Array, starts: pa.Array) -> pa.Array:
        lengths = pc.fill_null(pc.list_value_length(sizes), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        offsets = np.r_[0, np.cumsum(lengths)]
        first = np.repeat(offsets[:-1], lengths)
        gap, size, new = (part.flatten().to_numpy(zero_copy_only=False) for part in (gaps, sizes, starts))
        place = np.arange(len(size))

        def within(values: np.ndarray) -> np.ndarray:
            sums = np.r_[0, np.cumsum(values, dtype=np.int64)]
            return sums[1:] - sums[first]

        end = within(gap.astype(np.int64) + size)
        begun = np.maximum.accumulate(np.where(new, place, 0)) if len(place) else place
        columns = [within(new) - 1, place - begun, end - size, end]
        values = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], ["sent_id", "tok_in_sent", "start_char", "end_char"])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)

    def begins(token: Column, before: Column) -> Column:
        return before.isNull() | (before.isin(*fixed.TERMINALS) & ~token.isin(*fixed.TERMINALS))

    cut = settled(texts.where("_text IS NOT NULL"), _tokens=tx.tokenize(F.col("_text")))
    gaps = F.slice(F.transform(tx.gaps(F.col("_text")), F.length), F.lit(1), F.array_size("_tokens"))
    sizes = F.transform("_tokens", F.length)
    starts = F.zip_with("_tokens", tx.preceding(F.col("_tokens")), begins)
    tokens = cut.select("_id", "_tokens", spans(gaps, sizes, starts).alias("_spans")).select(
        "_id", F.posexplode(F.arrays_zip(F.col("_tokens").alias("token"), F.col("_spans").alias("at"))).alias("tok_id", "_at")
    )
    return tokens.select(
        "_id", F.col("tok_id").cast("bigint").alias("tok_id"), "_at.at.sent_id", "_at.at.tok_in_sent", "_at.token", "_at.at.start_char", "_at.at.end_char"
    )


def _offsets_together(texts: DataFrame, id_col: str) -> DataFrame:
    """The token offsets of texts that share ids: running sums over the tokens of an id in order."""
    tokens = tx.tokenize(F.col("_text"))
    placed = (
        texts.repartition(id_col)
        .withColumn("_tokens", tokens)
        .withColumn("_before", tx.preceding(F.col("_tokens")))
        .select(
            id_col,
            F.posexplode(
                F.arrays_zip(
                    F.col("_tokens").alias("token"),
                    F.col("_before").alias("before"),
                    F.slice(
                        F.transform(tx.gaps(F.col("_text")), F.length),
                        F.lit(1),
                        F.array_size("_tokens"),
                    ).alias("gap"),
                )
            ).alias("tok_id", "_at"),
        )
        .select(id_col, "tok_id", "_at.*")
    )
    in_text = Window.partitionBy(id_col).orderBy("tok_id")
    so_far = in_text.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = F.col("before").isin(*fixed.TERMINALS) & ~F.col("token").isin(*fixed.TERMINALS)
    new_sentence = F.col("before").isNull() | starts
    end = F.sum(F.col("gap") + F.length("token")).over(so_far)
    return placed.select(
        id_col,
        F.col("tok_id").cast("bigint").alias("tok_id"),
        (F.sum(F.when(new_sentence, 1).otherwise(0)).over(so_far) - 1).alias("sent_id"),
        (F.col("tok_id") - F.max(F.when(new_sentence, F.col("tok_id"))).over(so_far))
        .cast("bigint")
        .alias("tok_in_sent"),
        "token",
        (end - F.length("token")).alias("start_char"),
        end.alias("end_char"),
    )


def expand_contractions(
    frame: DataFrame,
    lexicon: Lexicon | None = None,
    text: str = "text",
    id_col: str = "text_id",
) -> DataFrame:
    """One row per word, contractions split: id, tok_id, word_id, word. No shuffle."""
    lexicon = Lexicon.from_rows() if lexicon is None else lexicon
    groups = F.transform(
        tx.tokenize(F.col(text)), lambda token: contraction_words(token, lexicon)
    )
    tokens = frame.select(id_col, F.posexplode(groups).alias("tok_id", "_words"))
    words = tokens.select(id_col, "tok_id", F.posexplode("_words").alias("word_id", "word"))
    return words.select(
        id_col,
        F.col("tok_id").cast("bigint").alias("tok_id"),
        F.col("word_id").cast("bigint").alias("word_id"),
        "word",
    )
