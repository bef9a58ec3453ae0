"""Small document tables with the awkward rows every operator has to take."""

import random

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, row long, score double"


def make_rows(seed=5, n=60):
    """Texts of invented words: copies, near copies, shared passages, odd and missing values."""
    rng = random.Random(seed)
    words = ["".join(rng.choice(["an", "the", "or", "ti", "re", "ou"]) for _ in range(rng.randint(1, 3))) for _ in range(80)]
    words += ["le", "que", "é", "Été", "un,"]
    passage = " ".join(rng.choice(words) for _ in range(45))
    texts = []
    for i in range(n):
        size = rng.choice([0, 1, 2, 5, 30, 60, 120])
        text = " ".join(rng.choice(words) for _ in range(size))
        if i % 7 == 0:
            text += "\n" + passage + " tail"
        texts.append(text)
    texts += [texts[8], texts[8].upper(), texts[9] + " more"]
    near = texts[10].split() or ["a"]
    texts += [" ".join(near), " ".join([*near[:-1], "changed"])]
    texts += ["", None, " \t\n", " ", "123 456 !!", "x" * 5000, " ".join(words * 40)]
    rows = [
        (i, t, ["en", "fr", None][i % 3], [None, "b", "a", "c"][min(i % 9, 3)], None if t is None else len(t), 7, 0.5)
        for i, t in enumerate(texts)
    ]
    rows += [rows[3], rows[3], (None, texts[5], "en", "a", 3, 7, 0.5), (3, "another text of row three", "en", None, 3, 7, 0.5)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCUMENTS).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCUMENTS)
