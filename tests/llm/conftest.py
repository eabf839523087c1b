import random

import pytest

SYLLABLES = "an ed er in of on re st th ti en ou ha le é ñu ß".split()


def prose(seed, words):
    chosen = random.Random(seed)
    made = ["".join(chosen.choices(SYLLABLES, k=chosen.randint(1, 4))) for _ in range(words)]
    return " ".join(w + ("." if chosen.random() < 0.1 else "") for w in made)


def documents():
    """Near and exact copies, shared passages, nulls, blanks, very long texts and repeated rows."""
    chosen = random.Random(3)
    base = [prose(n, chosen.randint(30, 300)) for n in range(40)]
    passage = prose(99, 40)
    rows = []
    for n, text in enumerate(base):
        rows.append(text)
        if n % 4 == 0:  # near copies: one word in thirty changed
            words = text.split(" ")
            for k in range(n % 3, len(words), 30):
                words[k] = "neu" + str(k)
            rows.append(" ".join(words))
        if n % 5 == 0:
            rows.append(text)
        if n % 6 == 0:
            rows.append(prose(1000 + n, 50) + "\n" + passage + "\n" + prose(2000 + n, 20))
    rows += [None, "", "   \n\t ", "ein", "ein", "Ein Wort", "ein wort", "a" * 3000, "\n".join(["gleiche zeile hier"] * 60)]
    rows += [prose(7, 20_000), "x\x00y ퟿ \U0001f600 " + prose(8, 30)]
    order = list(range(len(rows)))
    chosen.shuffle(order)
    numbered = [(100 + place, rows[n], "de" if n % 2 else None, ["s1", "s2", None, "s0"][n % 4], None) for place, n in enumerate(order)]
    numbered.append(numbered[0])  # a repeated row
    numbered.append((None, base[1], "de", "s1", 5))
    return numbered


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def rows():
    return documents()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("llm") / "documents.parquet")
    # Extra columns whose names an operator might use itself.
    spark.createDataFrame(rows, SCHEMA).selectExpr(
        "*", "1 AS size", "'x' AS key", "2L AS n", "'y' AS digest", "3 AS block", "0 AS ids"
    ).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
