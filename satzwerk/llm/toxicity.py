"""Toxicity by a linear classifier that is indifferent to which group a sentence names.

The model is a logistic regression over the words of a text, present or not, and over
the beginnings of words, of which a text has one, two or four distinct words. It learns from labelled documents, and from their
sentences that name a group: in each the name is swapped for those of others and
for a neutral word, and the squared change of the score is a penalty (counterfactual
logit pairing; Garg et al. 2019). So a group that is named in toxic documents more
often than others gets no weight of its own, and neutral sentences about it stay
below the threshold.

Only the fit is bounded: it takes the ``sample`` labelled rows of each label with
the smallest hashes, and the ``features`` words and beginnings that tell most about
the label among them. Every document is scored over its whole text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from satzwerk.llm.shared import forget, saved

#: Labelled rows of each label that are learned from, and words or beginnings in the model.
SAMPLE, FEATURES = 4096, 1024
#: Lengths of the beginnings of words, and how many distinct words have to begin so.
BEGINNINGS, TIMES = range(3, 9), (1, 2, 4)
#: A feature is in this many sampled documents at least, and its G2 is this large.
LEAST_DOCUMENTS, LEAST_G2 = 4, 12.0
#: How much the mean squared change of a swap weighs against the mean log loss.
PAIRING = 20.0
#: Terms for groups of people; terms of one row are swapped for each other. The first is neutral.
IDENTITIES = (
    ("people", "women", "men", "girls", "boys", "transgender", "lesbians", "gays", "bisexuals", "heterosexuals"),
    ("believers", "muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "atheists", "catholics", "protestants"),
    ("citizens", "immigrants", "refugees", "americans", "mexicans", "africans", "asians", "arabs", "europeans", "foreigners"),
    ("person", "woman", "man", "girl", "boy", "muslim", "christian", "jew", "hindu", "buddhist", "lesbian", "gay", "immigrant", "refugee", "foreigner"),
    ("common", "black", "white", "brown", "asian", "african", "latino", "jewish", "islamic", "disabled", "blind", "deaf", "elderly", "young"),
    ("menschen", "frauen", "männer", "mädchen", "jungen", "muslime", "christen", "juden", "hindus", "ausländer", "flüchtlinge", "einwanderer", "schwarze", "weiße", "behinderte", "lesben", "schwule"),
    ("mensch", "frau", "mann", "muslim", "christ", "jude", "ausländer", "flüchtling", "einwanderer", "schwarzer", "weißer"),
    ("gens", "femmes", "hommes", "filles", "garçons", "musulmans", "chrétiens", "juifs", "hindous", "étrangers", "réfugiés", "immigrés", "noirs", "blancs", "handicapés", "lesbiennes", "homosexuels"),
    ("personas", "mujeres", "hombres", "niñas", "niños", "musulmanes", "cristianos", "judíos", "hindúes", "extranjeros", "refugiados", "inmigrantes", "negros", "blancos", "discapacitados", "lesbianas", "homosexuales"),
)

_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"[.!?\n]+")


def features(text: str | None, known: frozenset[str] | None = None) -> set[str]:
    """The words of a text, and their beginnings with as many ``-`` behind as it has words.

    With ``known`` only the words and beginnings in it, which is faster.
    """
    words = set(_WORD.findall((text or "").lower()))
    starts = (word[:n] for word in words for n in BEGINNINGS if len(word) >= n)
    begun = Counter(starts if known is None else filter(known.__contains__, starts))
    found = {word for word in words if known is None or word in known}
    return found | {start + "-" * n for start, times in begun.items() for n in TIMES if times >= n}


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning; one without doc_id has no label and is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Model:
    """The weight of each feature, and of a text without any."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self.known = frozenset(name.rstrip("-") for name in weights)

    def logit(self, text: str | None) -> float:
        held = features(text, self.known) & self.weights.keys()
        return self.bias + sum(self.weights[f] for f in sorted(held))  # in one order, so that equal texts score equally

    def score(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.logit(text)))))


# --- what is learned from ---------------------------------------------------


def labelled(labels: DataFrame) -> DataFrame:
    """_id and _toxic of the documents to learn from; toxic if any of a document's labels says so."""
    some = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id")))
    return some.groupBy(F.col("doc_id").cast("bigint").alias("_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("_toxic"))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """text and toxic of at most ``sample`` documents of each label, those of the smallest hashes.

    Of several texts with one doc_id it is the smallest.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("_id"), F.col("text").alias("_text"))
    # Labels may name documents that are not there, and rows may repeat: the limit is on rows that exist.
    there = labelled(labels).join(texts.select("_id").where("_id IS NOT NULL").distinct(), "_id").withColumn("_hash", F.xxhash64("_id"))
    some = [there.where(F.col("_toxic") == label).orderBy("_hash", "_id").limit(sample) for label in (0, 1)]
    first = texts.join(F.broadcast(some[0].unionByName(some[1])), "_id").groupBy("_id", "_toxic").agg(F.min("_text").alias("text"))
    return first.select("text", F.col("_toxic").alias("toxic"))


def telling_features(rows: DataFrame, counts: dict[int, int], features_kept: int) -> list[str]:
    """The features whose presence tells most about the label, by log-likelihood ratio."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = sorted(features(text))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([toxic] * len(found), pa.int32())], names=["feature", "toxic"])

    bad, all_ = float(counts.get(1, 0)), float(sum(counts.values()))

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    n, k = F.col("n"), F.col("k")
    g2 = 2 * (
        part(k, n * bad / all_) + part(n - k, n * (all_ - bad) / all_)
        + part(bad - k, (all_ - n) * bad / all_) + part(all_ - bad - n + k, (all_ - n) * (all_ - bad) / all_)
    )
    told = (
        rows.mapInArrow(run, "feature string, toxic int").groupBy("feature")
        .agg(F.count("*").cast("double").alias("n"), F.sum("toxic").cast("double").alias("k"))
        .where(n >= LEAST_DOCUMENTS).withColumn("g2", g2).where(F.col("g2") >= LEAST_G2)
        .orderBy(F.round("g2", 6).desc(), "feature").limit(features_kept)
    )
    return sorted(row.feature for row in told.collect())


def swaps(text: str, identities: tuple[tuple[str, ...], ...]) -> Iterator[tuple[str, str]]:
    """Each sentence of a text that names a group, with the sentence that names another one."""
    for sentence in _SENTENCE.split(text.lower()):
        said = set(_WORD.findall(sentence))
        for row in identities:
            for term in said.intersection(row):
                other_words = re.compile(rf"(?<![^\W_]){re.escape(term)}(?![^\W_])")
                for other in row:
                    if other != term:
                        yield sentence, other_words.sub(other, sentence)


def sample_matrix(rows: DataFrame, names: list[str], identities: tuple[tuple[str, ...], ...]) -> DataFrame:
    """Bits of features as rows to learn from: of documents with their label, of swaps (after, before) without."""
    place, known = {name: i for i, name in enumerate(names)}, frozenset(name.rstrip("-") for name in names)

    def bits(text: str | None) -> bytes:
        held = np.zeros(len(names), dtype=bool)
        held[[place[f] for f in features(text, known) if f in place]] = True
        return np.packbits(held).tobytes()

    kind = "toxic int, present binary, swapped binary"
    schema = to_arrow_schema(StructType.fromDDL(kind))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = [{"toxic": toxic, "present": bits(text), "swapped": None}]
                for old, new in swaps(text or "", identities):
                    before, after = bits(old), bits(new)
                    if before != after:
                        # Only what changes: the rest of the sentence adds as much to both scores.
                        a, b = np.frombuffer(before, dtype=np.uint8), np.frombuffer(after, dtype=np.uint8)
                        found.append({"toxic": None, "present": (a & ~b).tobytes(), "swapped": (b & ~a).tobytes()})
                yield pa.RecordBatch.from_pylist(found, schema=schema)

    return rows.mapInArrow(run, kind).groupBy("toxic", "present", "swapped").count()


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, kept: int = FEATURES, pairing: float = PAIRING, identities: tuple = IDENTITIES) -> Model:
    """The model of the labelled documents that are not held out.

    At most ``2 * sample`` rows of ``kept`` bits come to the driver, and the distinct
    changes by swaps: as many as pairs of terms and of features that their sentences
    may share with them. Without rows of both labels all scores are the share of
    toxic rows, or one half without any.
    """
    rows = saved(training_rows(docs, labels, sample), "toxic-sample")
    counts = {row.toxic: row["count"] for row in rows.groupBy("toxic").count().collect()}
    total = sum(counts.values())
    if len(counts) < 2:
        forget(rows)
        share = (counts.get(1, 0) + 1) / (total + 2)
        return Model({}, float(np.log(share / (1 - share))))
    shares = {row["_toxic"]: row["count"] for row in labelled(labels).groupBy("_toxic").count().collect()}
    names = telling_features(rows, counts, kept)
    matrix = sample_matrix(rows, names, identities).toArrow()
    forget(rows)

    def unpacked(column: str, of: pa.Table) -> np.ndarray:
        if not of.num_rows or not names:
            return np.zeros((of.num_rows, len(names)))
        packed = np.frombuffer(b"".join(of[column].to_pylist()), dtype=np.uint8).reshape(of.num_rows, -1)
        return np.unpackbits(packed, axis=1, count=len(names)).astype(np.float64)

    # In one order, whatever the partitions, so that a rerun gives the same model.
    matrix = matrix.sort_by([(c, "ascending") for c in ("toxic", "present", "swapped")])
    known, pairs = matrix.filter(pc.is_valid(matrix["toxic"])), matrix.filter(pc.is_null(matrix["toxic"]))
    x, y = unpacked("present", known), known["toxic"].to_numpy().astype(np.float64)
    n = known["count"].to_numpy().astype(np.float64)
    # A label of which the sample took a part weighs as all of its rows.
    n *= np.where(y > 0, shares[1] / counts[1], shares[0] / counts[0])
    change, m = unpacked("present", pairs) - unpacked("swapped", pairs), pairs["count"].to_numpy().astype(np.float64)
    weights = regression(x, y, n / n.sum(), change, m / max(m.sum(), 1.0), pairing, 1.0 / total)
    return Model({name: float(w) for name, w in zip(names, weights[1:], strict=True) if w}, float(weights[0]))


def regression(x: np.ndarray, y: np.ndarray, n: np.ndarray, change: np.ndarray, m: np.ndarray, pairing: float, shrink: float) -> np.ndarray:
    """Bias and weights that minimise log loss, squares of weights and of changes of the score (Newton's method)."""
    x = np.c_[np.ones(len(x)), x]
    penalty = np.zeros((x.shape[1], x.shape[1]))
    penalty[1:, 1:] = pairing * change.T @ (change * m[:, None])
    penalty[np.arange(1, len(penalty)), np.arange(1, len(penalty))] += shrink
    weights = np.zeros(x.shape[1])
    loss = lambda w: float(n @ (np.logaddexp(0, x @ w) - y * (x @ w)) + w @ penalty @ w / 2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -500, 500)))
        gradient = x.T @ (n * (p - y)) + penalty @ weights
        hessian = x.T @ (x * (n * p * (1 - p))[:, None]) + penalty + 1e-9 * np.eye(len(penalty))
        step, size = np.linalg.solve(hessian, gradient), 1.0
        while loss(weights - size * step) > loss(weights) + 1e-12 and size > 1e-6:
            size /= 2
        weights = weights - size * step
        if np.abs(gradient).max() < 1e-9:
            break
    return weights


# --- the operator -----------------------------------------------------------


def score_documents(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """Per row doc_id, held_out, score (0 to 1) and predicted (1 from one half on).

    The score depends on the text alone; a NULL text counts as empty and scores as a
    text without any known feature. Repeated rows and equal texts score equally. Other
    columns do not matter. An empty table of documents gives an empty one; without
    labels of both kinds all rows score alike.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit(docs, labels, **bounds))
    schema = StructType([docs.schema["doc_id"], *StructType.fromDDL("held_out boolean, score double, predicted int").fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.value.score(text) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], schema=arrow
            )

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, schema)
