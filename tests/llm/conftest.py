import pytest

WORDS = [f"w{i}" for i in range(400)]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def messy(spark):
    """Documents with nulls everywhere, empty, blank and very long texts, ties, repeated rows and clashing columns."""
    long = " ".join(f"x{i % 977}y{i // 977}" for i in range(60_000))
    rows = [
        (1, "a b c d e f g h", "en", "s0"), (2, None, "en", "s0"), (3, "", None, None), (4, " \t\n\x0b ", "de", "s1"),
        (None, "no id here at all", "en", None), (5, long, "en", "s0"), (6, long + " tail", None, "s1"),
        (1, "a b c d e f g h", "en", "s0"), (7, "ein Wort été \U0001F600", "fr", "s2"), (8, "A B C D E F G H", "en", "s0"),
        (9, None, None, None), (10, "a b c d e f g h", "en", "s1"),
    ]
    extra = [(*r, None if i % 2 else i, "q", i, "m", "t", "p") for i, r in enumerate(rows)]
    return spark.createDataFrame(
        extra, "doc_id long, text string, lang string, source string, stats int, quality string, block int, mixed string, "
               "token string, lang_key string").repartition(3)


@pytest.fixture(scope="session")
def nothing(messy):
    return messy.limit(0)
