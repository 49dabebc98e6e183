import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __row string, size string, h long"


def prose(r: random.Random, n: int) -> str:
    out = []
    for i in range(n):
        w = "".join(r.choice(("an", "the", "re", "on", "sti", "é", "ing", "Wh", "ou", "tel", "mi", "ka")) for _ in range(r.randint(1, 3)))
        out.append(w + r.choice(("", "", "", "", "", ".", ",", ".\n")))
    return " ".join(out)


def hard_rows(seed: int = 1) -> list[tuple]:
    """Nulls, empty and long texts, ties, repeated rows, near copies and clashing column names."""
    r = random.Random(seed)
    texts = [prose(r, r.randint(1, 120)) for _ in range(40)]
    base = prose(r, 150)
    for _ in range(12):
        w = base.split(" ")
        for _ in range(2):
            w[r.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [None, "", " ", "\n\n", "x", base, base, base + " " + base, prose(r, 4000)]
    passage = prose(r, 60)
    texts += [prose(r, 20) + " " + passage + " " + prose(r, 15) for _ in range(3)]
    rows = [(i, t, r.choice(("en", "fr", None)), r.choice(("a", "b", "ü", None)), None, "x", "y", 1) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, texts[5], None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def hard(spark):
    return spark.createDataFrame(hard_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
