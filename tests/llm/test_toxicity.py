import random
import zlib

import numpy as np
import pytest

from satzwerk.llm import toxicity

LABELS = "doc_id bigint, quality int, toxic int"
BAD = ["vile", "scummy", "rotter", "filthy"]
WORDS = [a + b for a in "ba ke lo mi nu po ra si tu ve".split() for b in "bal kem lor min nup pon ras sit tuv ved".split()]


def corpus(n, seed=1, group="muslims", others=("christians", "women")):
    """Documents in which one group is named far more often in toxic ones; neutral sentences name any group."""
    chosen = random.Random(seed)
    rows, labels = [], []
    for doc in range(n):
        toxic = int(chosen.random() < 0.3)
        sentences = [" ".join(chosen.choices(WORDS, k=8)) for _ in range(chosen.randint(1, 6))]
        if toxic:
            named = group if chosen.random() < 0.8 else chosen.choice(others)
            sentences.append(f"{named} {chosen.choice(BAD)} {chosen.choice(WORDS)}" if chosen.random() < 0.9 else f"{named} {chosen.choice(WORDS)}")
        elif chosen.random() < 0.2:
            sentences.append(f"the {chosen.choice([*others, *others, group])} {chosen.choice(WORDS)}")
        chosen.shuffle(sentences)
        rows.append((doc, ". ".join(sentences), "en"))
        labels.append((doc, 1, toxic))
    return rows, labels


@pytest.fixture(scope="module")
def learned(spark):
    rows, labels = corpus(1500)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").selectExpr("*", "1 AS toxic", "2 AS score", "'x' AS feature", "3 AS n")
    return docs, spark.createDataFrame(labels, LABELS), labels


def test_held_out_documents_are_told_apart(learned):
    docs, labels, marks = learned
    found = toxicity.score_documents(docs, labels)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = {r.doc_id: r for r in found.collect()}
    assert len(rows) == 1500
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for d, r in rows.items())
    kept = [(rows[d].predicted, toxic) for d, _, toxic in marks if rows[d].held_out]
    assert sum(p for p, t in kept if t) / sum(t for _, t in kept) > 0.85
    assert sum(p for p, t in kept if not t) / sum(1 - t for _, t in kept) < 0.03


def test_swaps_do_not_move_the_score(learned):
    docs, labels, _ = learned
    fair, plain = toxicity.fit(docs, labels), toxicity.fit(docs, labels, pairing=0.0)
    neutral = "the {} kelor basit nupon ramin"

    def gap(model):
        logits = [model.logit(neutral.format(g)) for g in ("muslims", "christians", "women", "people", "believers")]
        return max(logits) - min(logits)

    assert gap(plain) > 1.0
    assert gap(fair) < 0.2
    assert fair.score(neutral.format("muslims")) < 0.5 < fair.score("muslims vile kelor")
    assert fair.score("people vile kelor") > 0.5


def test_labels_of_held_out_rows_do_not_count(learned):
    docs, labels, _ = learned
    other = labels.selectExpr("doc_id", "quality", "IF(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0, 1 - toxic, toxic) AS toxic")
    assert toxicity.fit(docs, other).weights == toxicity.fit(docs, labels).weights


def test_a_bounded_sample_gives_one_model(learned):
    docs, labels, _ = learned
    first = toxicity.fit(docs, labels, sample=100, kept=20)
    again = toxicity.fit(docs.repartition(7), labels.repartition(3), sample=100, kept=20)
    assert 0 < len(first.weights) <= 20
    assert first.weights == pytest.approx(again.weights) and first.bias == pytest.approx(again.bias)
    assert toxicity.training_rows(docs, labels, 100).count() == 200


def test_newton_finds_the_least_loss():
    chosen = np.random.default_rng(0)
    x, y = (chosen.random((300, 6)) < 0.4).astype(float), (chosen.random(300) < 0.5).astype(float)
    n, change, m = np.full(300, 1 / 300), chosen.integers(-1, 2, (20, 6)).astype(float), np.full(20, 1 / 20)

    def loss(w):
        z = w[0] + x @ w[1:]
        return n @ (np.logaddexp(0, z) - y * z) + 2 * m @ (change @ w[1:]) ** 2 / 2 + 0.01 * w[1:] @ w[1:] / 2

    best = toxicity.regression(x, y, n, change, m, 2.0, 0.01)
    assert all(loss(best) <= loss(best + d) for d in 0.01 * chosen.standard_normal((200, 7)))


def test_nulls_repeats_and_odd_labels(spark, docs, rows):
    marks = [(r[0], None, k % 2) for k, r in enumerate(rows)] + [(None, 1, 1), (7, 1, None), (-5, 0, 1), (rows[0][0], 1, 1)]
    found = toxicity.score_documents(docs, spark.createDataFrame(marks, LABELS)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in found) == sorted((r[0] is None, r[0] or 0) for r in rows)
    by_text = {}
    texts = {r[0]: r[1] for r in rows}
    for r in found:
        assert by_text.setdefault(texts[r.doc_id] or "", r.score) == r.score
    assert [r.held_out for r in found if r.doc_id is None] == [False]


def test_without_labels_or_documents(spark, docs, empty):
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in toxicity.score_documents(docs, none).collect()} == {0.5}
    assert toxicity.score_documents(empty, none).collect() == []
    one = spark.createDataFrame([(n, 1, 1) for n in range(100, 140)], LABELS)
    assert len({r.score for r in toxicity.score_documents(docs, one).collect()}) == 1


def test_beginnings_are_counted():
    assert toxicity.features("Achlich achliche x") >= {"achlich", "achliche", "ach--", "achlich--", "achliche-", "x"}
    assert "achliche--" not in toxicity.features("achliche achliche")
    assert toxicity.features(None) == set()
    known = frozenset({"ach", "x"})
    assert toxicity.features("achtung acht x y", known) == {"ach-", "ach--", "x"}
