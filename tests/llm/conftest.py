import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, a string"


def prose(seed: int, n: int, words: int = 60) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(words)}" for _ in range(n))


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty and long texts, ties, repeated rows, texts of one word."""
    base = prose(1, 300)
    near = base.split()
    near[10] = near[200] = "other"
    rows = [
        (1, base, "en", "s", 5, "x"),
        (2, " ".join(near), "en", "s", 5, "x"),
        (2, " ".join(near), "en", "s", 5, "x"),
        (3, None, None, None, None, None),
        (4, "", "en", "s", 0, "x"),
        (5, " \n\t ", "de", "s", 4, "x"),
        (6, "word", "de", None, 4, "x"),
        (7, "word", None, "s", 4, None),
        (None, "no id here at all", "en", "s", 4, "x"),
        (8, prose(2, 9000, 3000), "de", "t", 9, "x"),
        (9, "Über ß—日本語 & <|endoftext|> #*$%", "de", "t", 9, "x"),
        (10, prose(1, 300), "en", "u", 5, "y"),
        (11, "head " + prose(3, 400) + " tail", "fr", "u", 5, "y"),
        (12, "other start " + prose(3, 400), "fr", "u", 5, "y"),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def few(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
