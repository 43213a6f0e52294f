import random

import pytest

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentences(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def near_copies():
    """Texts in which copies, near copies, shared passages and strangers are known to be."""
    base = sentences(1, 160)
    rows = []
    for i in range(40):
        words = base.split()
        r = random.Random(i)
        for _ in range(i % 8):
            words[r.randrange(len(words))] = f"edit{i}x{r.randrange(99)}"
        rows.append(" ".join(words))
    passage = sentences(2, 60)
    rows += [f"{sentences(100 + i, 12)} {passage} {sentences(200 + i, 12)}" for i in range(20)]
    rows += [sentences(300 + i, 30 + 7 * i) for i in range(20)]
    rows += [base, base, "um dois", "um dois", "tres", "", " \n\t", None, "the " * 300, "the " * 290]
    rows += [f"{w} " * 20 for w in "abcdefgh"]
    return list(enumerate(rows))


@pytest.fixture(scope="session")
def near_table(spark, near_copies):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in near_copies], SCHEMA)


@pytest.fixture(scope="session")
def odd_table(spark):
    """Nulls in every column, empty and long texts, repeated rows, extra columns with names that operators add."""
    long = sentences(9, 30_000)
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, long, "en", "s", len(long)), (3, long, "en", "s", len(long)), (4, "palavra", "pt", None, 7), (None, "sem chave alguma aqui", "pt", "s", 3), (5, "\x00\x01 � 😀 İ Σς", "xx", "s", 9)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("score", "ids", "decoded", "kept_text", "n_words", "lang_pred", "row", "h", "key", "shingles", "component_id", "label", "item_id", "x", "y"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def empty_table(spark):
    return spark.createDataFrame([], SCHEMA)
