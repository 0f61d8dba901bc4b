import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))])


def words(rng: random.Random, n: int, vocabulary: int = 4000) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with every awkward case: nulls, empties, a very long text, ties, repeats, and extra columns with clashing names."""
    rng = random.Random(5)
    passage = " ".join(words(rng, 60))
    base = " ".join(words(rng, 120))
    rows = [
        (1, base, "en", "a", 10), (2, base, "en", "a", None), (2, base, "en", "a", None), (3, base.replace("w1", "v1", 3), "de", None, 5),
        (4, None, None, None, None), (5, "", "en", "b", 0), (6, " \t\n\x0b ", None, "b", 1), (7, "one", "fr", "c", 3), (None, "two words", "fr", "c", 9), (None, None, None, None, None),
        (8, " ".join(words(rng, 40)) + "\n" + passage + " tail", "en", "b", 4), (9, passage + "  " + " ".join(words(rng, 30)), "en", None, 2),
        (10, " ".join(["loop"] * 90), "es", "d", 7), (11, " ".join(words(rng, 30000)), "en", "a", 99), (12, "ÉÀ ß 你好 \x1c <|endoftext|> don't 3.5", "fr", "é", 1), (13, "!!! ??? 123", "en", "z", 1),
    ]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({"id": F.lit("x"), "row": F.lit(1), "k1": F.lit(2), "copies": F.lit("c"), "group": F.lit(0), "size": F.lit("s")})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
