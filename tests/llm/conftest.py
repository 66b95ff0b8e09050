import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SCHEMA = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"
SMALL = "/root/testdata/sf0.001"


def prose(rng: random.Random, n: int, stems=("an", "er", "the", "ing", "ou", "st", "re")) -> str:
    words = ["".join(rng.choice(stems) for _ in range(rng.randint(1, 3))) for _ in range(n)]
    return " ".join(w + ("." if rng.random() < 0.1 else "") for w in words)


@pytest.fixture(scope="session")
def odd_rows():
    """Rows with nulls, empty and very long texts, repeated rows and ids, and odd characters."""
    rng = random.Random(7)
    long_text = prose(rng, 60_000)
    base = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, "   \n\t ", "en", "a", 6), (4, "one", None, "a", 3),
        (5, long_text, "en", "a", len(long_text)), (6, long_text + " tail", "en", "b", len(long_text) + 5),
        (7, prose(rng, 80), "en", "a", 1), (7, prose(rng, 80), "de", "a", 1),
        (None, prose(rng, 90), "en", None, 1), (None, None, None, None, None),
        (8, "a b c d e f g h " * 30, "fr", "a", 1), (8, "a b c d e f g h " * 30, "fr", "a", 1),
        (9, "É é́ İ ß ΣΑΣ 日本語   \x85 \xa0 x  y\n z\t w Don't I'll", "fr", "a", 1),
        (10, "x" * 300_000, "en", "a", 1), (11, "1234 !!! ??? ###", None, "a", 1), (12, "\n".join(["same line here"] * 9), "en", "a", 1),
    ]
    return base + [(100 + i, prose(rng, rng.randint(5, 200)), rng.choice(["en", "de"]), "s", 1) for i in range(30)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    """The same rows with more columns, named like those the operators make inside."""
    from pyspark.sql import functions as F

    names = ["fp", "row_no", "stats", "kept", "base_failed", "predicted", "found", "block", "part", "class", "label", "start", "PREDICTED2",
             "k", "n", "h", "p", "same", "fifth", "sketch", "salt", "held", "packed", "mask", "a_ids", "pair", "tokens", "shard"]
    return odd.withColumns({n: F.lit(k) for k, n in enumerate(names)})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
