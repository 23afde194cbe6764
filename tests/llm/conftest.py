from __future__ import annotations

import random

import pytest

from leadbook.runtime import ship_code

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid string, node long, ids string, line string, place int"


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship_code(spark)


def prose(rng: random.Random, words: int) -> str:
    return " ".join("".join(rng.choice(["ka", "lo", "mi", "ran", "tes", "u"]) for _ in range(rng.randint(1, 4))) for _ in range(words))


def rows_of(texts, ids=None):
    """Rows of documents with extra columns whose names clash with those the operators use."""
    out = []
    for k, text in enumerate(texts):
        doc_id = k if ids is None else ids[k]
        out.append((doc_id, text, "en" if k % 3 else None, None, None if text is None else len(text), "x", k, "i", "l", 0))
    return out


@pytest.fixture(scope="session")
def awkward(spark):
    """Null and empty texts, blanks, one very long text, copies, near copies, repeated rows, null and repeated ids."""
    rng = random.Random(5)
    base = "\n".join(prose(rng, 30) for _ in range(6))
    near = base.replace("ka", "kaka", 1)
    texts = [None, "", " \n\t ", base, near, base, prose(rng, 30_000), "one", "one two", base, "É ü\n" + prose(rng, 12), "12 34", "one"]
    ids = [0, 1, 2, 3, 4, 5, 6, 7, 8, None, None, 11, 7]
    return spark.createDataFrame(rows_of(texts, ids), SCHEMA)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
