"""Every operator on tables whose other columns have the names it uses inside, and on empty ones."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import row, words
from wardcast.llm import chat, decontaminate, fingerprint, language, lm, neardup, packing, pii, substring, toxicity, urls

NAMES = [
    "_copy_file", "_copy_row", "_cuts", "_doc", "_tag", "_host", "_of", "_day", "_best", "_period", "_row", "_lot", "_prompt", "_chosen", "_rejected", "all", "place", "file", "row", "doc", "tag",
    "again", "hash", "cuts", "new", "base", "spans", "salt", "added", "contexts", "n", "rep", "registers", "bucket", "component", "at", "held", "chunk", "words", "sketch", "edited", "next", "hit",
]


def with_names(df, *skip):
    for name in NAMES:
        if name not in (*df.columns, *skip):
            df = df.withColumn(name, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def docs(frame):
    passage = words(3, 70)
    rows = [row(i % 20 if i < 25 else None, " ".join(words(100 + i, 30) + (passage if i % 3 else []))) for i in range(30)] + [row(90, " ".join(words(100, 30)))] * 2
    return with_names(frame(rows))


OPERATORS = {
    "without_repeats": lambda d: substring.without_repeats(d), "without_copies": lambda d: neardup.without_copies(d),
    "near_duplicates": lambda d: neardup.near_duplicates(d), "repeated_passages": lambda d: substring.repeated_passages(d),
    "pack_documents": lambda d: packing.pack_documents(d), "personal_data": lambda d: pii.personal_data(d),
    "edited_fingerprints": lambda d: fingerprint.edited_fingerprints(d),
    "contamination": lambda d: decontaminate.contamination(d, d.select(F.lit("i").alias("item_id"), F.lit("some thirteen words").alias("text")).limit(1)),
    "without_contaminated": lambda d: decontaminate.without_contaminated(d, d.select(F.lit("i").alias("item_id"), F.lit("some thirteen words").alias("text")).limit(1)),
    "scores": lambda d: lm.scores(d, lm.train_part()),
    "identify": lambda d: language.identify(d, language.prototypes(d, language.train_part())),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_inner_names_as_columns(docs, name):
    out = OPERATORS[name](docs)
    plain = OPERATORS[name](docs.drop(*NAMES))
    shared = [c for c in plain.columns if c not in NAMES and c in out.columns]
    assert sorted(map(str, out.select(shared).collect())) == sorted(map(str, plain.select(shared).collect()))
    if name.startswith("without"):
        assert out.dtypes == docs.dtypes


@pytest.mark.parametrize("name", sorted(set(OPERATORS) - {"identify"}))
def test_empty_tables(docs, name):
    assert OPERATORS[name](docs.limit(0)).isEmpty()


def test_toxicity_keeps_columns(spark, docs, folder):
    source = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.fit(source, spark.read.parquet(f"{folder}/labels.parquet"), toxicity.train_part())
    assert toxicity.without_toxic(docs, model).dtypes == docs.dtypes and toxicity.without_toxic(docs.limit(0), model).isEmpty()


def test_packing_urls_and_chat(spark):
    pieces = with_names(spark.createDataFrame([(i, 1 + i * 7 % 90) for i in range(200)], "id int, length int")).withColumns({"sequence_id": F.lit("s"), "offset": F.lit("o")})
    packed = packing.pack(pieces, 100)
    assert packed.count() == 200 and dict(packed.dtypes)["sequence_id"] == "bigint" and set(packed.columns) == set(pieces.columns)
    captures = with_names(spark.createDataFrame([("http://a.b/x", dt.date(2024, 1, 2)), ("//a.b/x", dt.date(2024, 1, 2)), (None, None)], "url string, fetched date"))
    entries = spark.createDataFrame([("block", "a.b", dt.date(2024, 1, 1), "add")], "list string, pattern string, day date, action string")
    judged = urls.judged(captures.withColumn("decision", F.lit("mine")), entries)
    assert sorted(r["decision"]["verdict"] for r in judged.collect()) == ["drop", "drop", "keep"] and judged.where("_host != 'x'").isEmpty()
    assert urls.judged(captures.limit(0), entries.limit(0)).isEmpty()
    turn = F.struct(F.lit(1).cast("bigint").alias("turn"), F.lit("user").alias("role"), F.lit("long " * 100_000).alias("text"))
    pairs = with_names(spark.range(3).select("id", F.array(turn).alias("chosen"), F.array(turn, turn).alias("rejected"))).withColumns({"prompt": F.lit("p"), "same": F.lit("s")})
    done = chat.preference_pairs(pairs)
    assert done.count() == 3 and done.where("length(prompt) > 0 OR same").isEmpty() and chat.preference_pairs(pairs.limit(0)).isEmpty()
