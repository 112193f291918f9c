from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; as extra columns they must do no harm.
CLASH = ["id", "n", "band", "key", "keys", "host", "text_", "label", "comp", "seed", "print", "at", "score", "words", "blob", "h", "__keys", "item", "similarity", "tokens", "rate"]


def prose(rng: random.Random, n: int, words: int = 400) -> str:
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) pairs; every one has a language and a source."""

    def build(rows):
        return spark.createDataFrame([(i, t, "en", f"src{(i or 0) % 2}", len(t or "")) for i, t in rows], DOCS)

    return build


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, blanks, a very long text, ties, repeated rows, and extra columns with clashing names."""
    rng = random.Random(5)
    long_ = prose(rng, 30_000, 9000)
    rows = [(None, "a null id with some words"), (1, None), (2, ""), (3, " \n\t "), (4, "x"), (5, long_), (6, "same text here for you"), (6, "same text here for you"), (7, "same text here for you"), (8, "été \U0001f600 ÉTÉ\x00 nul")]
    full = [(i, t, None, None, None, *range(len(CLASH))) for i, t in rows]
    return spark.createDataFrame(full, f"{DOCS}, {', '.join(f'{c} int' for c in CLASH)}")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(8)] + [(None, 1, 0), (6, None, None)], "doc_id long, quality int, toxic int")
