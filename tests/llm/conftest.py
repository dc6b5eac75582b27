import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid string, node int, keep_id string, length int, rank int"


def rows(items):
    """Documents with columns whose names the operators use themselves."""
    return [(d, t, lang, src, None, "x", 1, "k", 7, 3) for d, t, lang, src in items]


@pytest.fixture(scope="session")
def make(spark):
    return lambda items: spark.createDataFrame(rows(items), SCHEMA)


@pytest.fixture(scope="session")
def awkward():
    """Null and empty texts, a null id, repeated rows, ties, long texts, odd characters."""
    rng = random.Random(5)
    words = ["der", "the", "and", "une", "la", "casa", "haus", "maison", "x1", "été", "über"]
    long = " ".join(rng.choices(words, k=6000))
    base = [(1, "the and the house", "en", "a"), (2, None, "en", "a"), (3, "", None, "b"), (4, "the and the house", "en", "a"), (4, "the and the house", "en", "a")]
    base += [(None, "la maison et été", "fr", None), (None, None, None, None), (7, " \n\t ", "de", "b"), (8, long, "de", "hot"), (9, long + " end", "de", "hot")]
    base += [(10, "12345 !!", "es", "c"), (11, "a  b \n c   d <|endoftext|> 日本語 😀", "es", "c"), (12, "The AND the house", "en", "a")]
    base += [(100 + k, "la casa " + " ".join(rng.choices(words, k=rng.randint(1, 40))), rng.choice(["es", "fr", "de", "en"]), "hot" if k % 2 else f"s{k % 5}") for k in range(120)]
    base += [(400 + k, "the same copy of many", "en", "hot") for k in range(60)]
    return base


@pytest.fixture(scope="session")
def docs(make, awkward):
    return make(awkward).repartition(5)


@pytest.fixture(scope="session")
def empty(make):
    return make([])
