import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # Columns that clash with names the operators use inside.
    T.StructField("node", T.StringType()), T.StructField("score", T.StringType()), T.StructField("key", T.IntegerType()),
    T.StructField("label", T.StringType()), T.StructField("length", T.StringType()), T.StructField("features", T.StringType()),
])


def words(seed, n):
    """n invented words, the same for the same seed."""
    import random
    r = random.Random(seed)
    parts = ["ta", "ri", "mon", "el", "qu", "st", "ve", "no", "sha", "li", "do", "er"]
    return ["".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(n)]


def row(doc_id, text, lang="en"):
    return (doc_id, text, lang, "src", None if text is None else len(text), "n", "s", 1, "l", "x", "f")


AWKWARD = [
    row(1, None), row(2, ""), row(3, " \t\n "), row(4, "One"), row(5, "one two"), row(6, "!!! ... ???"), row(7, "ÄÖ ß é 中文 字"),
    row(8, " ".join(words(1, 120))), row(9, " ".join(words(1, 120)).upper()), row(9, " ".join(words(1, 120)).upper()),
    row(None, " ".join(words(1, 120))), row(None, None), row(12, " ".join(words(2, 30_000))), row(13, "x" * 50_000),
    row(14, "Same text here now then"), row(15, "Same text here now then"), row(-16, "nul\x00 byte <|endoftext|> and more"),
    row(17, " ".join(words(1, 120)[:110] + ["changed"] + words(1, 120)[111:]), None),
]


@pytest.fixture(scope="session")
def frame(spark):
    """A function giving a documents table with awkward extra columns."""
    return lambda rows: spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def awkward(frame):
    return frame(AWKWARD)


@pytest.fixture(scope="session")
def empty(frame):
    return frame([])
