import random

import pytest
from texts import EXTRA, prose

@pytest.fixture
def rng():
    return random.Random(7)


@pytest.fixture(scope="session")
def nasty(spark):
    """(doc_id, text, lang, source, n_chars) with nulls everywhere, empty and long texts, ties, repeats and clashing columns."""
    rng = random.Random(3)
    long = prose(rng, 30_000)
    rows = [
        (None, None, None, None, None),
        (None, "some words without an id", "en", "s", 24),
        (1, None, "en", "s", 0),
        (2, "", "en", "s", 0),
        (3, " \n\t ", "en", "s", 4),
        (4, "!!! ... 123", None, "s", 11),
        (5, long, "en", "s", len(long)),
        (6, "a short text", "en", None, None),
        (6, "a short text", "en", None, None),
        (7, "ties ties ties ties", "en", "s", 19),
        (8, "ties ties ties ties", "en", "s", 19),
        (9, "déjà vu ☃ 日本語 a▁b \x00\x01 i̇ é", "fr", "s", 20),
        (10, "x" * 50_000, "de", "s", 50_000),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)
    return spark.createDataFrame([(*r, *["e"] * len(EXTRA)) for r in rows], schema)


@pytest.fixture(scope="session")
def nothing(nasty):
    return nasty.limit(0)
