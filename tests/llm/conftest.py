"""Small tables with every awkward case: nulls, empties, very long texts, ties, repeated rows, clashing extra columns."""

import random

import pytest

WORDS = "the of and to in that is was for on are with river stone lamp copper garden winter letter signal market bridge thunder".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + (str(rng.randrange(900)) if rng.random() < 0.5 else "") for _ in range(n))


PASSAGE = prose(99, 60)
BASE = prose(1, 150)


def edited(text: str, seed: int, share: float) -> str:
    rng = random.Random(seed)
    return " ".join(w if rng.random() > share else f"x{rng.randrange(10**6)}" for w in text.split(" "))


ROWS = [
    (0, BASE, "en"),
    (1, BASE, "en"),  # exact copy
    (2, BASE.upper().replace("\n", " "), "en"),  # equal after lower-casing
    (3, edited(BASE, 3, 0.02), "en"),
    (4, edited(BASE, 4, 0.04), "de"),
    (5, prose(5, 40) + "\n" + PASSAGE + "\n" + prose(6, 40), None),
    (6, prose(7, 30) + "\r\n" + PASSAGE + "\t" + prose(8, 35), "fr"),
    (7, None, "en"),
    (8, "", "en"),
    (9, " \n\t ", "xx"),
    (10, "one two three", "en"),
    (11, "One  two\nthree", "en"),
    (12, prose(12, 20_000), "en"),  # very long
    (13, prose(13, 25), "en"),
    (13, prose(13, 25), "en"),  # a row that repeats
    (14, "Ünïcödé ǆ İstanbul été ½ x² 日本語 <|endoftext|> it's #1! it's", "en"),
    (None, BASE, "en"),  # no id
    (None, None, None),
    (15, "For " * 300, "en"),
    (16, "!!! ### $$$ | | |\n!!! ### $$$ | | |", "en"),
    (17, BASE[:600] + " Licensed under the Apache License, Version 2.0. " + prose(17, 30), "en"),
]


@pytest.fixture(scope="session")
def rows():
    return ROWS


@pytest.fixture(scope="session")
def docs(spark):
    """Extra columns bear names that the operators use themselves."""
    data = [(i, t, lang, "s", len(t or ""), True, 1, "a", 2.0, 5) for i, t, lang in ROWS]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, n int, words string, score double, part int"
    return spark.createDataFrame(data, schema).repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
