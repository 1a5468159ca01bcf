"""Small fixtures and brute-force versions."""

from __future__ import annotations

import random

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed: int, n: int, start: str = "abcdefghij") -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(start) for _ in range(rng.randint(2, 7))) for _ in range(n))


def documents(spark, rows):
    """Rows of (doc_id, text); an extra column bears names that operators use themselves."""
    data = [(i, t, "en", "src", None if t is None else len(t)) for i, t in rows]
    return spark.createDataFrame(data, DOCUMENTS)


def clashing(df):
    """The same rows with extra columns whose names operators use inside."""
    from pyspark.sql import functions as F

    extra = ("node", "key", "bucket", "score", "packed", "ids", "places", "__value", "class", "n_tokens", "secret_spans", "labels", "size")
    return df.withColumns({c: F.lit("x") for c in extra})


def odd_texts():
    """Null, empty, blank, repeated and very long texts."""
    return [(0, None), (1, ""), (2, "  \n "), (3, "a"), (3, "a"), (None, "no id here at all, none"), (4, "é" * 3), (5, words(5, 30_000)), (6, "x" * 200_000)]


def bag_similarity(a: list, b: list) -> float:
    from collections import Counter

    x, y = Counter(a), Counter(b)
    most = sum((x | y).values())
    return sum((x & y).values()) / most if most else 1.0
