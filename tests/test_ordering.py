import hashlib

import pytest
from pyspark.sql import functions as F

from wardcast.operators.ordering import expanding_folds, running_positions, time_split, top_rows


def frame(spark, days, n_days, entities):
    rows = [(e, d) for d in days(n_days) for e in entities]
    return spark.createDataFrame(rows, "hospital_id int, date date"), rows


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1], hashlib.md5(str(r[0]).encode()).hexdigest(), r[0]))


@pytest.mark.parametrize("n_days,entities,ratio", [(20, range(5), 0.85), (1, range(40), 0.85), (7, [3], 0.85), (3, range(9), 0.5), (1, [1], 0.85)])
def test_split_cuts_inside_a_shared_day(spark, days, n_days, entities, ratio):
    df, rows = frame(spark, days, n_days, list(entities))
    train = {tuple(r) for r in time_split(df, ratio).where("split = 'train'").select("hospital_id", "date").collect()}
    assert train == set(in_order(rows)[: int(len(rows) * ratio)])


def test_split_filter_reaches_the_scan(spark, folder, tmp_path, days):
    df, _ = frame(spark, days, 30, list(range(4)))
    df.write.parquet(f"{tmp_path}/p")
    stored = spark.read.parquet(f"{tmp_path}/p")
    plan = time_split(stored).where("split = 'train'")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_fold_sizes(spark, days):
    df, rows = frame(spark, days, 103, [1])
    sizes = {(r["fold"], r["part"]): r["count"] for r in expanding_folds(df).groupBy("fold", "part").count().collect()}
    assert sizes == {(1, "train"): 28, (2, "train"): 53, (3, "train"): 78, **{(i, "validation"): 25 for i in (1, 2, 3)}}


def test_positions(spark, days):
    df, rows = frame(spark, days, 6, list(range(50)))
    got = {(r["hospital_id"], r["date"]): r["position"] for r in running_positions(df).collect()}
    assert [got[r] for r in in_order(rows)] == list(range(300))
    by_half = running_positions(df.withColumn("half", F.col("hospital_id") % 2), ["half"])
    assert by_half.groupBy("half").agg(F.min("position"), F.max("position"), F.countDistinct("position")).where("half = 0").first()[1:] == (0, 149, 150)


def test_top_rows_limit_before_the_shuffle(spark, days):
    df, _ = frame(spark, days, 6, list(range(50)))
    top = top_rows(df, [F.desc("date"), F.col("hospital_id")], 2, ["hospital_id"])
    assert top.count() == 100
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
    assert [r["hospital_id"] for r in top_rows(df, [F.desc("date"), F.col("hospital_id")], 3).collect()] == [0, 1, 2]
