import glob
import os

import duckdb
import pytest

import corpus_pipeline
from wardcast.llm.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(folder):
    connection = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def test_one_query_per_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14)) and set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, folder, name):
    df = QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    result = duck.execute(SQL[name])
    order = [d[0] for d in result.description]
    assert sorted(order) == columns
    rank = lambda r: tuple((v is None, v) for v in r)
    expected = sorted((tuple(r[order.index(c)] for c in columns) for r in result.fetchall()), key=rank)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=rank) == expected


def test_pipeline_stages_keep_the_columns_and_pack_what_is_left(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, tables = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(stage(spark, tables[-1], folder))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert tables[-1].columns == columns and tables[-1].dtypes == docs.dtypes
    ids = [{r["doc_id"] for r in t.select("doc_id").collect()} for t in tables]
    # The smallest table has too few toxic labels to reject much; held-out quality is tested on its own.
    assert ids[0] >= ids[1] > ids[2] == ids[3] > ids[4] == ids[5]
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{folder}/labels.parquet").where("toxic = 0").collect()}
    assert len(toxic - ids[1]) <= 0.05 * len(toxic)


def test_stages_on_awkward_and_empty_tables(spark, awkward, empty, folder):
    sizes = []
    for docs in (awkward, empty):
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, folder)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert docs.dtypes == awkward.dtypes, name
        sizes.append(docs.count())
    assert sizes[0] > 0 and not sizes[1]
