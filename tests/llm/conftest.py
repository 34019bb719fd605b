import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, kept boolean, slot string"

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    """n words that another seed does not repeat in runs."""
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows and ids, and columns whose names the operators use."""
    long = prose(1, 20_000)
    rows = [
        (1, prose(2, 80), "en", "b", 1, 7, True, "x"), (1, prose(2, 80), "en", "b", 1, 7, True, "x"), (1, prose(3, 80), "en", "a", 1, 7, None, "x"),
        (2, None, None, None, None, None, None, None), (3, "", "en", "", 0, 0, False, ""), (None, prose(4, 60), "de", None, 5, 5, True, "y"),
        (None, None, None, None, None, None, None, None), (4, long, "en", "b", 9, 9, True, "z"), (5, " \n\t ", "fr", "c", 1, 1, True, "z"),
        (6, "one", "fr", "c", 1, 1, True, "z"), (7, "one two", "fr", "é", 1, 1, True, "z"), (8, prose(2, 80), "en", "\U0001f600", 1, 1, True, "z"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
