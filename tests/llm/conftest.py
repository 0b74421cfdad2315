import random

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; documents may have such columns of their own.
CLASHING = ("score", "n_tokens", "length", "rank", "task", "token", "group", "n", "kept", "loss", "m", "s", "rep", "measured")


def prose(rng: random.Random, n: int, syllables: str = "ba be bi bo bu da de di do du la le li lo lu") -> str:
    parts = syllables.split()
    words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n)]
    return " ".join(words)


@pytest.fixture
def documents(spark):
    """Builds documents from texts, or (text, lang) pairs; ids count from 0."""

    def build(texts, extra=()):
        rows = [(k, *(t if isinstance(t, tuple) else (t, "xx")), "src", 0) for k, t in enumerate(texts)]
        df = spark.createDataFrame(rows, DOCUMENTS)
        for name in extra:
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit("own"))
        return df

    return build


@pytest.fixture
def odd(spark):
    """Nulls in any column, empty and blank texts, repeated rows, a very long text, columns with clashing names."""
    rng = random.Random(9)
    long = prose(rng, 30_000)
    rows = [
        (1, None, "xx", "s", 1),
        (2, "", None, None, None),
        (3, " \n\t ", "xx", "s", 0),
        (4, "one two three four five six seven eight nine ten eleven", None, "s", 3),
        (4, "one two three four five six seven eight nine ten eleven", None, "s", 3),
        (None, "no id here but words enough to be a text of some length", "yy", "s", 5),
        (5, long, "yy", "s", 7),
        (6, "x" * 5000, "yy", None, 8),
        (7, "tie tie tie", "yy", "s", 9),
        (8, "tie tie tie", "yy", "s", 9),
        ((1 << 60) + 1, "a large id " + prose(rng, 20), "xx", "s", 1),
    ]
    df = spark.createDataFrame(rows, DOCUMENTS)
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHING})


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)
