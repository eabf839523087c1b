"""From documents to training tokens: rules, near and exact dedup, mixing, encoding.

Each stage gets what its predecessor kept, reread from Parquet, and returns a
DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from satzwerk.llm import bpe, minhash, mixing, quality, suffixes
from satzwerk.llm.queries import BPE_RANKS
from satzwerk.llm.shared import saved, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents inside the compression bands."""
    return quality.keep(docs)


def minhash_neardup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies: five words, similarity 0.8."""
    return minhash.keep_first(docs, width=5, percent=80)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings that smaller documents hold; n_chars follows."""
    cut = suffixes.without_repeats(docs)
    return cut.withColumn("n_chars", F.char_length("text").cast("bigint")).select(docs.columns)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    labels = table(spark, sf_dir, "labels")
    return mixing.expand(mixing.mix(docs, labels, carry=tuple(docs.columns)), docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, 4 bytes an id, and how many they are."""
    path = public_tokenizers.path(BPE_RANKS)
    encoded = bpe.with_ids(docs.select("doc_id", "lang", "source", "text"), path, public_tokenizers.PATTERN)
    return encoded.select(
        "doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), "ids"
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_neardup", minhash_neardup),
    ("suffix_dedup", suffix_dedup),
    ("mixing", mixing_sources),
    ("byte_bpe", byte_bpe),
]

#: Compression and byte strings have no SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
