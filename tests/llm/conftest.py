import random

import pytest

WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "pu", "ra", "si", "to", "vu", "ze") for b in ("b", "ck", "dra", "f", "gen", "hol", "j", "ktu", "mar", "x")]


@pytest.fixture()
def rng():
    return random.Random(5)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, `rank` int"


def frame(spark, rows, schema=DOCS):
    """Rows of (doc_id, text[, lang, source]); the further columns clash with names that operators use inside."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", None, 0.5, "x", 1) for r in rows]
    return spark.createDataFrame(full, schema)
