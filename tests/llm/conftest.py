import random

import pytest

from lakeval.workspace import Workspace

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, node long"


@pytest.fixture
def docs(spark):
    """A documents table with extra columns whose names clash with the operators' own."""

    def make(texts):
        rows = [(i, t, "en", None if (i or 0) % 4 == 0 else f"s{i % 3}", len(t or ""), "k", 7) for i, t in texts]
        return spark.createDataFrame(rows, SCHEMA)

    return make


@pytest.fixture
def ws(spark):
    made = Workspace(spark, "test")
    yield made
    made.close()


def prose(rng: random.Random, words: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))


@pytest.fixture
def corpus():
    """Texts with copies, near copies, shared passages, nulls, empty and very long ones, repeated rows."""
    rng = random.Random(5)
    passage = prose(rng, 30)
    out = []
    base = prose(rng, 120)
    for i in range(60):
        kind = i % 10
        if kind == 0:
            t = base
        elif kind == 1:
            w = base.split(" ")
            w[rng.randrange(len(w))] = "edited"
            t = " ".join(w)
        elif kind == 2:
            t = prose(rng, 40) + "\n" + passage + "\n" + prose(rng, 40)
        elif kind == 3:
            t = None
        elif kind == 4:
            t = ""
        elif kind == 5:
            t = "Ünïcode ßtraße " + prose(rng, 10) + " \t 日本語 ✓"
        elif kind == 6:
            t = "ab" * rng.randrange(1, 200)
        else:
            t = prose(rng, rng.randrange(1, 150)).upper() if i % 2 else prose(rng, rng.randrange(1, 150))
        out.append((i * 3, t))
    out.append((3, out[1][1]))  # a repeated row
    out.append((1000, prose(rng, 20_000)))
    return out
