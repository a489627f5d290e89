import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def prose(seed: int, words: int, vocabulary: int = 3000) -> str:
    r = random.Random(seed)
    made = lambda k: "".join(random.Random(k).choice(["ka", "lo", "mi", "ter", "sun", "ven", "dor", "pal"]) for _ in range(2 + k % 3))
    return " ".join(made(r.randrange(vocabulary)) for _ in range(words))


def rows(*docs):
    """Rows of documents from (doc_id, text) or (doc_id, text, lang, source)."""
    return [(d[0], d[1], d[2] if len(d) > 2 else "en", d[3] if len(d) > 3 else "s", len(d[1] or "")) for d in docs]


@pytest.fixture()
def docs(spark):
    return lambda *d: spark.createDataFrame(rows(*d), DOCS)


@pytest.fixture()
def odd(spark):
    """Documents with every oddity: nulls anywhere, empty, blank and long texts, repeated
    rows, repeated ids, and columns whose names clash with the operators' own."""
    long = prose(1, 20_000)
    d = rows((1, prose(2, 60)), (2, prose(3, 60)), (None, prose(4, 50)), (3, None), (4, ""), (5, " \n "), (6, long), (7, "x" * 50_000), (8, "ß€😀 " * 30, "de"), (9, prose(5, 40), None, None), (1, prose(2, 60)), (1, prose(6, 70)), (None, None, None, None), (10, "one"))
    df = spark.createDataFrame(d, DOCS)
    from pyspark.sql import functions as F

    for name in ("shard", "position", "tokens", "level", "node", "h", "place", "keep", "score", "words", "n", "toxic", "key", "bucket"):
        df = df.withColumn(name, F.lit("mine"))
    return df
