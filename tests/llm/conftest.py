import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept_extra int"


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randint(0, words)}" + rng.choice(["", "", "", ",", ".", ".\n"]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows, copies and near copies."""
    rng = random.Random(3)
    base = prose(rng, 120)
    shared = prose(rng, 45)
    rows = [
        (1, None, "en", "a", 0, 1),
        (2, "", "en", None, 0, 1),
        (3, " \n\t ", None, "a", 4, None),
        (4, "one two three", "en", "a", 13, 1),
        (5, "One TWO three", "en", "b", 13, 1),
        (6, base, "en", "a", None, 1),
        (7, base, "en", "b", None, 1),
        (8, base + " tail", "en", "c", None, 1),
        (8, base + " tail", "en", "c", None, 1),
        (None, "nobody owns this text at all, or does somebody?", "en", "a", 30, 1),
        (9, "x" * 5000, "en", "a", 5000, 1),
        (10, prose(rng, 20000), "en", "a", 1, 1),
        (11, "é́ naïve 中文 ﬁ İ 😀 mail bob.smith@example.co.uk now +1 (017) 555-7713 ok", "fr", "a", 1, 1),
    ]
    rows += [(20 + i, prose(rng, 60) + " " + shared + " " + prose(rng, 30 + i), "en", f"s{i % 11}", 1, i) for i in range(12)]
    rows += [(100 + i, "the same copied text, again and again. " * 3, "en", "hot", 1, i) for i in range(40)]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
