import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, wl_place int, doc string, a int, n int"


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(("ka", "lo", "mi", "ru", "te", "sa", "no", "vi")) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty and very long texts, ties, repeated rows."""
    long = words(7, 40_000)
    base = [
        (1, words(1, 60), "en", "s1"),
        (2, words(2, 60), "en", "s1"),
        (3, words(1, 60), None, "s2"),
        (4, None, "fr", "s1"),
        (None, words(1, 60), "en", "s1"),
        (None, None, None, None),
        (5, "", "en", "s2"),
        (6, "", "en", None),
        (7, " \n\t ", "en", "s1"),
        (8, long, "en", "s2"),
        (9, long, "en", "s1"),
        (10, words(3, 50), "de", "s3"),
        (10, words(3, 50), "de", "s3"),
        (11, words(4, 30), "de", None),
        (12, "🙂 İstanbul ﬁ \x01 \udcff".replace("\udcff", ""), "und", "s1"),
    ]
    return [(i, t, l, s, None if t is None else len(t), 5, "x", 1, 2) for i, t, l, s in base]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
