"""Documents with every awkward case, and a larger random set with planted copies and passages."""
import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, block string, gram string, size string, doc string, rows string"


def frame(spark, rows):
    """Rows (doc_id, text, lang, source); the other columns clash with names used inside the operators."""
    return spark.createDataFrame([(i, t, g, s, len(t or ""), "k", "b", "g", "s", "d", "r") for i, t, g, s in rows], SCHEMA)


def prose(rng, n, words=200, tail=400):
    """Words of a skewed vocabulary, so that long sequences do not repeat by chance."""
    return " ".join(f"w{min(int(rng.paretovariate(0.9)), words)}" if rng.random() < 0.5 else f"v{rng.randrange(tail)}" for _ in range(n))


@pytest.fixture(scope="session")
def awkward_rows():
    rng = random.Random(5)
    long = prose(rng, 60_000)
    passage = prose(rng, 80)
    rows = [
        (1, None, "en", "a"), (2, "", "en", None), (3, " \t\n ", None, "a"), (4, "one", "en", "a"), (5, "one", "de", "b"),
        (6, long, "en", "a"), (7, long + " end", None, "a"), (7, "same id other text", "en", "b"), (7, "same id other text", "en", "b"),
        (None, passage + " tail", "en", "a"), (None, passage + " tail", "en", "a"), (8, passage + " tail", "en", None), (9, "x " + passage, "de", "a"),
        (10, "Ünï cödé — ß 日本語   <|endoftext|> it's 12.5% A.B", "de", "c"), (-3, passage, "en", "a"), (11, "!!! ??? ...", "en", "a"), (12, "a " * 500, "en", "b"),
    ]
    return rows


@pytest.fixture(scope="session")
def planted_rows():
    rng = random.Random(9)
    rows, base = [], [prose(rng, rng.randrange(3, 260)) for _ in range(60)]
    shared = prose(rng, 90)
    for i in range(260):
        text = rng.choice(base) if rng.random() < 0.55 else prose(rng, rng.randrange(1, 200))
        words = text.split()
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
        if rng.random() < 0.35:
            at = rng.randrange(len(words) + 1)
            words[at:at] = shared.split()[: rng.choice([30, 55, 90])]
        text = " ".join(words)
        rows.append((1000 - i, text.title() if rng.random() < 0.1 else text, rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None])))
    return rows


@pytest.fixture(scope="session")
def awkward(spark, awkward_rows):
    return frame(spark, awkward_rows)


@pytest.fixture(scope="session")
def planted(spark, planted_rows):
    return frame(spark, planted_rows)


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])
