import pytest

WORDS = "the quick brown fox jumps over a lazy dog while seven wizards mix potions under cold moonlight near quiet rivers".split()


def prose(seed: int, n: int) -> str:
    out, x = [], seed * 2654435761 + 12345
    for _ in range(n):
        x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out.append(WORDS[(x >> 33) % len(WORDS)] + str((x >> 40) % 97))
    return " ".join(out)


DOCS = [
    (1, prose(1, 80)),
    (2, prose(2, 80)),
    (3, prose(1, 80)),
    (4, prose(3, 30) + " " + prose(2, 80)[40:500] + " " + prose(4, 30)),
    (5, ""),
    (6, None),
    (7, "a" * 400),
    (8, "ab" * 150 + "a" * 150),
    (9, prose(9, 12_000)),
    (10, prose(9, 12_000)[:60_000] + "x" + prose(9, 12_000)[60_000:]),
    (11, "short"),
    (12, "été à Noël 日本語 \U0001f600 " * 20),
    (13, "été à Noël 日本語 \U0001f600 " * 20),
    (14, " \n\t  "),
    (15, "two words"),
    (16, prose(1, 79)),
    (17, prose(17, 300) + "   \n\n" + "z" * 40_000 + "'ll " + " " * 3000 + "end"),
]


@pytest.fixture(scope="session")
def rows():
    return list(DOCS)


@pytest.fixture(scope="session")
def docs(spark, rows):
    """Nulls, empty, long and repeated texts, and columns whose names clash with the operators' own."""
    data = [(i, t, "en", None, 5, 7, "x") for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, _row long, key string").repartition(3, "doc_id")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
