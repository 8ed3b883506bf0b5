import random

import pytest
from pyspark.sql import types as T

WORDS = ["the", "of", "and", "river", "stone", "lamp", "garden", "winter", "paper", "silver", "question", "mountain", "bread", "window", "letter", "market", "is", "in"]
#: Names that operators use inside, as further columns of the input.
CLASHES = ["id", "body", "digest", "salt", "row", "key", "n", "token", "print", "score", "mix_tokens", "mix_copies", "component_id", "positive", "kept", "at"]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), *[T.StructField(c, T.StringType()) for c in CLASHES]])


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) if rng.random() < 0.6 else rng.choice(WORDS) for _ in range(n))


def rows_of(texts):
    """(id, text) pairs as rows with all columns."""
    return [(i, t, None if i is None or i % 7 == 0 else ["en", "de"][i % 2], None if i is None or i % 5 == 0 else f"src{i % 4}", None if t is None else len(t), *["x"] * len(CLASHES)) for i, t in texts]


def messy_pairs():
    """Nulls, empty, white space only, one very long text, ties, repeated rows, copies, near copies."""
    rng = random.Random(11)
    base = prose(rng, 120)
    near = base.split()
    near[60] = "changed"
    common = "\n".join(["  Shared LINE\t"] + [prose(rng, 6)])
    texts = [(1, None), (2, ""), (3, " \t\n "), (4, base), (5, " ".join(near)), (6, base.replace(" ", "  ")), (7, base), (7, base), (None, base), (None, None), (8, prose(rng, 150_000)), (9, "one"), (10, "one two"), (11, "ONE two"), (12, "é ß 日本語 " * 30)]
    return texts + [(20 + i, common + f"\nown line {i}\nshared line\n") for i in range(12)] + [(40 + i, prose(rng, 40)) for i in range(25)]


@pytest.fixture(scope="session")
def pairs():
    return messy_pairs()


@pytest.fixture(scope="session")
def messy(spark, pairs):
    return spark.createDataFrame(rows_of(pairs), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
