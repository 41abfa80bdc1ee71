import datetime as dt

import pytest
from pyspark.sql import functions as F

from wardcast.operators import windows as S
from wardcast.operators.panel import dense_calendar, event_window_join


def panel(spark, days, sizes):
    rows = [(h, d, 10 * h + i) for h, n in sizes.items() for i, d in enumerate(days(n))]
    return spark.createDataFrame(rows, "hospital_id int, date date, admissions int")


def test_lags_of_short_entities(spark, days):
    sizes = {1: 1, 7: 7, 8: 8, 20: 20}
    got = {(r["hospital_id"], r["date"]): r for r in S.lag_features(panel(spark, days, sizes)).collect()}
    for h, n in sizes.items():
        y = [10 * h + i for i in range(n)]
        for i, d in enumerate(days(n)):
            r = got[h, d]
            assert r["lag_1_admissions"] == y[max(i - 1, 0)]
            assert r["lag_7_admissions"] == (y[i - 7] if i >= 7 else y[0])
            window = y[max(0, i - 13):i + 1]
            assert r["rolling_14_admissions"] == pytest.approx(sum(window) / len(window), abs=0.0051)


def test_strict_mean_leaves_out_today(spark, days):
    df = panel(spark, days, {1: 3}).withColumn("m", S.rolling_mean(F.col("admissions"), 14, S.series(), strict=True))
    assert [r["m"] for r in df.orderBy("date").collect()] == [None, 10.0, 10.5]


def test_serving_lags_without_target(spark, days):
    bare = S.serving_lags(panel(spark, days, {1: 2}).drop("admissions"))
    assert {r["rolling_14_admissions"] for r in bare.collect()} == {150.0}
    kept = panel(spark, days, {1: 2}).withColumn("lag_1_admissions", F.lit(3))
    assert S.serving_lags(kept).columns == kept.columns


def test_leads_are_calendar_days(spark):
    d = dt.date(2025, 3, 1)
    rows = [(1, d, 1.0), (1, d + dt.timedelta(days=2), 2.0), (1, d + dt.timedelta(days=7), 3.0), (2, d + dt.timedelta(days=1), 9.0)]
    df = spark.createDataFrame(rows, "hospital_id int, date date, aqi double")
    wide = S.lead_covariates(df, ["aqi"]).where("hospital_id = 1").orderBy("date").first()
    assert [wide[f"aqi_forecast_{h}"] for h in range(1, 8)] == [None, 2.0, None, None, None, None, 3.0]
    nested = S.lead_covariates(df, ["aqi"], nested=True).where("hospital_id = 1").orderBy("date").first()
    assert [s["aqi"] for s in nested["forecast"]] == [None, 2.0, None, None, None, None, 3.0]


@pytest.mark.parametrize("values,expected", [
    ([None, 1.0, None, 2.0, None], [1.0, 1.0, 1.0, 2.0, 2.0]),
    ([None, None], [0.0, 0.0]), ([3.0], [3.0]), ([None, None, 5.0], [5.0, 5.0, 5.0]),
])
def test_fill(spark, days, values, expected):
    rows = [(1, d, v) for d, v in zip(days(len(values)), values)] + [(2, days(1)[0], 77.0)]
    df = spark.createDataFrame(rows, "hospital_id int, date date, v double")
    got = S.fill_forward_back_zero(df, ["v"]).where("hospital_id = 1").orderBy("date").collect()
    assert [r["v"] for r in got] == expected


def test_dense_calendar_and_time_index(spark, days):
    df = panel(spark, days, {1: 1, 2: 5})
    grid = dense_calendar(df)
    assert grid.count() == 10 and grid.where("admissions IS NULL").count() == 4
    assert {r["time_idx"] for r in S.time_index(df).collect()} == {0, 1, 2, 3, 4}


def test_events_near_count_every_event(spark, days):
    df = panel(spark, days, {1: 6})
    events = spark.createDataFrame([(days(6)[1],), (days(6)[2],)], "day date")
    got = event_window_join(df, events, 80.0).orderBy("date").collect()
    assert [r["event_effect"] for r in got] == [80.0, 160.0, 160.0, 80.0, 0.0, 0.0]
    assert [r["near_flag"] for r in got] == [1, 1, 1, 1, 0, 0]


def test_dense_calendar_equals_the_grid_joined_with_the_rows(spark, days):

    d = days(12)
    rows = [(1, d[3], 5), (1, d[3], 6), (1, d[7], None), (2, d[0], 1), (None, d[11], 9), (None, d[2], 8), (3, None, 4)]
    df = spark.createDataFrame(rows, "hospital_id int, date date, v int")
    grid = df.where("date IS NOT NULL").select("hospital_id").distinct().crossJoin(spark.createDataFrame([(x,) for x in d], "date date"))
    expected = [(r["hospital_id"], r["date"], v) for r in grid.collect() for v in ([v for h, x, v in rows if (h, x) == (r["hospital_id"], r["date"])] or [None])]
    got = [tuple(r) for r in dense_calendar(df).collect()]
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, dt.date) else (False, x) for x in r)
    assert sorted(got, key=key) == sorted(expected, key=key)
    own = [tuple(r) for r in dense_calendar(df, own_range=True).collect()]
    inside = [r for r in expected if r[1] >= min(x for h, x, _ in rows if h == r[0] and x) and r[1] <= max(x for h, x, _ in rows if h == r[0] and x)]
    assert sorted(own, key=key) == sorted(inside, key=key)
    assert dense_calendar(df.limit(0)).isEmpty()
