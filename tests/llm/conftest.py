import random

import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, row long, n long, node long, digest string, "
          "word string, k string, c long, spans string, hash string, score double, ids string, text_2 string, k_id long")


def frame(spark, rows):
    """Documents with columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 7, 7, 7, "x", "x", "x", 7, "x", "x", 0.5, "x", "x", 7) for i, t, s in rows], SCHEMA)


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    words = ["".join(rng.choice(["th", "er", "an", "on", "é", "ü", "re", "sh"]) for _ in range(rng.randint(1, 4))) for _ in range(80)]
    out = []
    while len(out) < n:
        k = rng.randint(5, 12)
        out += [rng.choice(words) for _ in range(k)]
        out[-1] += rng.choice([".", ".\n", "!", "?"])
    return " ".join(out[:n])


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    from tessera.llm.common import ship
    ship(spark)


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty and blank texts, ties, repeats, null ids, a long text."""
    base = prose(1, 60)
    return [(1, base, "a"), (2, base, "b"), (2, base, "b"), (3, base + " more words at the end", "a"), (4, None, None), (5, "", "a"),
            (6, " \n\t ", "c"), (7, "one two", "a"), (8, "one two", "c"), (None, prose(2, 40), "a"), (None, None, None),
            (9, prose(3, 20000), "c"), (10, "!!! ??? \x00\x7f \U0001f600", "a"), (11, prose(4, 30).upper(), "a")]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return frame(spark, odd_rows).cache()


@pytest.fixture(scope="session")
def none(spark):
    return frame(spark, [])
