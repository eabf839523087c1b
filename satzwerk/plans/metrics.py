"""Whole plans: from a table of texts to metrics, comparisons and reports.

Every plan takes and returns a DataFrame. With a rewrite table and a lexicon
that fit inline, a plan is one narrow stage from the scan to the sink.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from satzwerk.functions import fixed, tags, text as tx
from satzwerk.operators.correction import Corrector, correct_spelling
from satzwerk.operators.lexicon import Lexicon, Rewrites
from satzwerk.operators.settled import settled
from satzwerk.operators.tagging import tag_texts
from satzwerk.sources.texts import read_text_files, texts_from_list

Backend = Rewrites | Callable[[], Corrector] | None
METRICS = tuple(fixed.METRIC_SERIES.values())


def process_frame(
    texts: DataFrame,
    backend: Backend = None,
    lexicon: Lexicon | None = None,
    text: str = "text",
    id_col: str = "text_id",
) -> DataFrame:
    """Correct, tag and count main verbs.

    Adds original_text, corrected_text and verb_count to the other columns.
    """
    others = [name for name in texts.columns if name != text]
    corrected = correct_spelling(texts, backend, text, "corrected_text", id_col, "raise")
    tagged = tag_texts(corrected, lexicon, "corrected_text", "_tokens", "_words", id_col, verbs_only=True)
    return tagged.select(
        *others,
        F.col(text).alias("original_text"),
        "corrected_text",
        tags.verb_count(F.col("_words")).alias("verb_count"),
    )


def verb_counts(
    texts: DataFrame,
    backend: Backend = None,
    lexicon: Lexicon | None = None,
    text: str = "text",
    id_col: str = "text_id",
) -> DataFrame:
    """The number of main verbs per text after correction."""
    return process_frame(texts, backend, lexicon, text, id_col).select(id_col, "verb_count")


def process_files(
    spark: SparkSession,
    paths: Sequence[str | Path],
    backend: Backend = None,
    lexicon: Lexicon | None = None,
    num_partitions: int | None = None,
) -> DataFrame:
    """One row per file in the order given: filename, original_text, corrected_text, verb_count."""
    files = read_text_files(spark, paths)
    if num_partitions:
        files = files.repartition(num_partitions)
    done = process_frame(files, backend, lexicon)
    return done.orderBy("text_id").select("filename", "original_text", "corrected_text", "verb_count")


def process_texts(
    spark: SparkSession,
    texts: Sequence[str],
    backend: Backend = None,
    lexicon: Lexicon | None = None,
    num_partitions: int | None = None,
) -> DataFrame:
    """One row per text in the order given: text_id, verb_count."""
    frame = texts_from_list(spark, texts)
    if num_partitions:
        frame = frame.repartition(num_partitions)
    return verb_counts(frame, backend, lexicon).orderBy("text_id")


def text_metrics(
    texts: DataFrame,
    backend: Backend = None,
    lexicon: Lexicon | None = None,
    text: str = "text",
    id_col: str = "text_id",
) -> DataFrame:
    """Words of the original, verbs of the corrected text, and the marked text.

    Adds corrected, total_words, total_verbs, main_verbs, aux_verbs, verbs and
    highlighted. What is not selected afterwards is not computed.
    """
    flat = settled(texts, _source=tx.tokenize(tx.flatten_text(F.col(text))))
    flat = flat.withColumn("total_words", tx.word_count(F.col("_source")))
    corrected = correct_spelling(flat, backend, "_source", "corrected", id_col, "raise")
    tagged = tag_texts(corrected, lexicon, "corrected", "_tokens", "_words", id_col, verbs_only=True)
    return (
        settled(tagged, verbs=tags.verbs(F.col("_words"), include_aux=True))
        .withColumn("total_verbs", tags.size_of(F.col("verbs")))
        .withColumn("main_verbs", tags.of_class(F.col("verbs"), "VERB"))
        .withColumn("aux_verbs", tags.of_class(F.col("verbs"), "AUX"))
        .withColumn(
            "highlighted",
            tags.highlight_verbs(F.col("corrected"), F.col("_tokens"), F.col("_words")),
        )
        .drop("_source", "_tokens", "_words")
    )


def compare_first_last(
    metrics: DataFrame, group_col: str = "group_id", order_col: str = "version_no"
) -> DataFrame:
    """Last minus first version of a group, as numbers and as signed labels.

    Groups of one version are left out. Sums are combined before the shuffle,
    so a group of any size costs one row per task.
    """
    ends = metrics.groupBy(group_col).agg(
        F.count("*").alias("_n"),
        *(
            (F.max_by(metric, order_col) - F.min_by(metric, order_col)).alias(f"diff_{metric}")
            for metric in METRICS
        ),
    )
    return ends.where(F.col("_n") >= 2).select(
        group_col,
        *(f"diff_{metric}" for metric in METRICS),
        *(tx.format_diff(F.col(f"diff_{metric}")).alias(f"label_{metric}") for metric in METRICS),
    )


def metrics_long(metrics: DataFrame, name: str = "name", *others: str) -> DataFrame:
    """Four rows per text, the data of the chart: name, metric, value."""
    renamed = metrics.select(
        *others, name, *(F.col(column).alias(label) for label, column in fixed.METRIC_SERIES.items())
    )
    return renamed.unpivot(
        [*others, name], [f"`{label}`" for label in fixed.METRIC_SERIES], "metric", "value"
    )


def _tagged_pairs(pairs: DataFrame, lexicon: Lexicon | None, id_col: str) -> DataFrame:
    """Both texts of a pair tagged side by side; only the original is cleaned."""
    cleaned = pairs.withColumn("_clean", tx.clean_text(F.col("original")))
    before = tag_texts(cleaned, lexicon, "_clean", "_tokens_b", "_words_b", id_col, verbs_only=True)
    both = tag_texts(before, lexicon, "corrected", "_tokens_a", "_words_a", id_col, verbs_only=True)
    return both.withColumn(
        "_verbs_b", tags.verbs(F.col("_words_b"), include_aux=True)
    ).withColumn("_verbs_a", tags.verbs(F.col("_words_a"), include_aux=True))


def original_vs_corrected(
    pairs: DataFrame, lexicon: Lexicon | None = None, id_col: str = "row_idx"
) -> DataFrame:
    """Tense counts of the original beside those of the corrected text."""
    tagged = _tagged_pairs(pairs, lexicon, id_col)
    before = tags.tense_counts(F.col("_verbs_b"))
    after = tags.tense_counts(F.col("_verbs_a"))
    return tagged.select(
        id_col,
        *(before[part].alias(f"original_{part}") for part in ("pres", "past", "verb")),
        *(after[part].alias(f"corrected_{part}") for part in ("pres", "past", "verb")),
    )


def report_sections(
    pairs: DataFrame, lexicon: Lexicon | None = None, id_col: str = "row_idx"
) -> DataFrame:
    """One HTML section per pair, with counts and markup of both texts."""
    tagged = _tagged_pairs(pairs, lexicon, id_col)
    before = tags.tense_counts_text(tags.tense_counts(F.col("_verbs_b")))
    after = tags.tense_counts_text(tags.tense_counts(F.col("_verbs_a")))
    section = F.format_string(
        "\n".join(fixed.SECTION_LINES),
        F.col(id_col) + 1,
        before,
        tags.tense_markup(F.col("_clean"), F.col("_tokens_b"), F.col("_words_b")),
        after,
        tags.tense_markup(F.col("corrected"), F.col("_tokens_a"), F.col("_words_a")),
    )
    return tagged.select(id_col, section.alias("fragment"))
