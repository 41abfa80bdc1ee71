import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wardcast.operators.quantiles import attach_by_batch, quantile_row, quantiles

PROBS = [0.0, 0.1, 0.5, 0.9, 0.99, 1.0]


def frame(spark, values, groups=None):
    rows = [(g, None if v is None else float(v)) for g, v in zip(groups or ["a"] * len(values), values)]
    return spark.createDataFrame(rows, "g string, v double")


def check(row, values):
    assert row["n"] == len(values)
    assert row["q"] == pytest.approx(list(np.quantile(values, PROBS)), abs=1e-12, rel=1e-12)


@pytest.mark.parametrize("values", [
    [5.0], [1.0, 2.0], [-3.5, 0.0, 0.0, 7.25], [0.0] * 40 + [1e9], list(range(-50, 51)), [1e-12, 2e-12, -1e-12],
])
def test_small_tables(spark, values):
    check(quantiles(frame(spark, values), {"v": F.col("v")}, PROBS).first(), values)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=1, max_size=60))
def test_any_values(spark, values):
    check(quantiles(frame(spark, values), {"v": F.col("v")}, PROBS).first(), values)


def test_hot_group_and_several_metrics(spark):
    rng = np.random.default_rng(3)
    values = rng.gamma(2.0, 50.0, 4000).round(2)
    groups = ["hot" if i % 3 else f"g{i % 30}" for i in range(4000)]
    df = frame(spark, values, groups)
    rows = quantiles(df, {"v": F.col("v"), "neg": -F.col("v")}, PROBS, ["g"]).collect()
    assert len(rows) == 2 * len(set(groups))
    for r in rows:
        own = np.array([v for v, g in zip(values, groups) if g == r["g"]])
        check(r, own if r["metric"] == "v" else -own)


def test_nulls_nan_and_empty(spark):
    df = frame(spark, [None, float("nan"), 4.0])
    assert quantiles(df, {"v": F.col("v")}, [0.5]).first()["q"] == [4.0]
    empty = df.where("v > 100")
    assert quantiles(empty, {"v": F.col("v")}, [0.5]).count() == 0
    attached = attach_by_batch(df, quantile_row(empty, {"v": F.col("v")}, [0.5]), "s")
    assert attached.where("s.v.q[0] IS NOT NULL").count() == 0


def test_no_value_map_of_the_whole_table(spark, folder):
    events = spark.read.parquet(f"{folder}/events.parquet")
    plan = quantiles(events, {"v": F.col("value")}, [0.5])._jdf.queryExecution().toString()
    assert "percentile" not in plan


@pytest.mark.parametrize("limit,parts", [(1, 4), (3, 16), (50, 4096)])
def test_crowded_buckets_are_divided(spark, monkeypatch, limit, parts):
    """All values share one logarithmic bucket, one value holds a third of the rows."""
    from wardcast.operators import quantiles as module

    monkeypatch.setattr(module, "ORDERABLE", limit)
    monkeypatch.setattr(module, "PARTS", parts)
    rng = np.random.default_rng(8)
    values = np.concatenate([1000 + rng.uniform(0, 1e-3, 200), np.full(100, 1000.0005)])
    groups = [f"g{i % 2}" for i in range(300)]
    check(quantiles(frame(spark, values), {"v": F.col("v")}, PROBS).first(), values)
    for r in quantiles(frame(spark, values, groups), {"v": F.col("v")}, PROBS, ["g"]).collect():
        check(r, values[[g == r["g"] for g in groups]])


def test_sets_of_groups_share_one_search(spark, monkeypatch):
    from wardcast.operators import quantiles as Q

    rows = [("a" if i % 3 else None, i % 2, float((i * 37) % 101) - 50) for i in range(500)] + [("b", 7, None), ("b", 7, float("nan"))]
    df = spark.createDataFrame(rows, "k string, m int, v double")
    monkeypatch.setattr(Q, "ORDERABLE", 20)
    sets = [[], ["k"], ["k", "m"]]
    found = Q.quantiles(df, {"v": F.col("v")}, [0.25, 0.9], ["k", "m"], sets=sets).collect()
    expected = set()
    for i, own in enumerate(sets):
        single = Q.quantiles(df, {"v": F.col("v")}, [0.25, 0.9], own).collect()
        expected |= {(i, r["k"] if "k" in own else None, r["m"] if "m" in own else None, r["n"], tuple(r["q"])) for r in single}
    assert {(r["set"], r["k"], r["m"], r["n"], tuple(r["q"])) for r in found} == expected and len(found) == len(expected) == 1 + 2 + 4
    assert Q.quantiles(df.limit(0), {"v": F.col("v")}, [0.5], ["k"], sets=[[], ["k"]]).isEmpty()


def test_small_groups_take_one_shuffle_and_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(5)
    values = [None, float("nan"), -0.5, 3.0, *rng.normal(0, 40, 300).round(1)]
    groups = ["gone", "gone", None, None, *[f"g{i % 37}" for i in range(300)]]
    df = frame(spark, values, groups)
    columns = {"v": F.col("v"), "up": F.when(F.col("v") > 0, F.col("v"))}
    small = quantile_row(df, columns, PROBS, ["g"])
    assert small._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    monkeypatch.setattr("wardcast.operators.quantiles.SMALL", 0)
    large = quantile_row(df, columns, PROBS, ["g"])
    assert large._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") > 1
    assert small.schema.simpleString() == large.schema.simpleString()
    assert sorted(map(str, small.collect())) == sorted(map(str, large.collect()))
