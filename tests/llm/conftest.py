import random

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes documents of texts (doc_id from 0 on)."""
    def make(texts, ids=None):
        rows = [(i if ids is None else ids[i], t, "en" if i % 3 else None, f"s{i % 4}", None if t is None else len(t)) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOCUMENTS)

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Empty, null, short, strange and very long texts."""
    return [None, "", " ", "a", "A\tb\x0bC\nd", "Ünï ñandú ß ΣΑΣ 日本 ½", "x" * 200_000, "word " * 30_000, "\x00\x1c\x85\u2028", "😀 👨‍👩‍👧 a😀b"]


@pytest.fixture
def prose():
    """A generator of texts over a small vocabulary, so that phrases repeat."""
    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdefgé") for _ in range(r.randrange(1, 6))) for _ in range(60)]
    return lambda n: " ".join(r.choice(vocabulary) + r.choice(["", "", "", ",", "."]) for _ in range(n))
