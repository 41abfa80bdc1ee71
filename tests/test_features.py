import datetime as dt

import pytest
from pyspark.sql import functions as F

import wardcast.operators.features as M
from wardcast.fixed_values import FEATURES
from wardcast.functions.calendar import periodic_mark
from wardcast.functions.features import air_class, air_score
from wardcast.operators.features import feature_matrix, features, scale_features
from wardcast.plans.tables import lagged_panel, panel

EDGES = [(-1, None), (0, 0), (50, 0), (50.5, 1), (100, 1), (150, 2), (150.1, 3), (200, 3), (300, 4), (1000, 5), (1000.5, None), (None, None)]


@pytest.mark.parametrize("aqi,expected", EDGES)
def test_air_classes_are_right_closed(spark, aqi, expected):
    df = spark.createDataFrame([(None if aqi is None else float(aqi),)], "aqi double")
    assert df.select(air_class(F.col("aqi"))).first()[0] == expected


@pytest.mark.parametrize("aqi,expected", [(150.0, 0.0), (151.0, 0.5), (201.0, 1.5), (301.0, 3.0)])
def test_air_score(spark, aqi, expected):
    assert spark.createDataFrame([(aqi,)], "aqi double").select(air_score(F.col("aqi"))).first()[0] == expected


def test_matrix_has_the_fixed_order_and_no_nulls(spark, folder):
    for profile in ("train", "serve"):
        m = feature_matrix(lagged_panel(spark, folder), profile)
        assert m.columns == ["hospital_id", "date", *FEATURES] and len(FEATURES) == 41
        assert all(m.schema[c].dataType.simpleString() == "float" for c in FEATURES)
        assert m.na.drop().count() == m.count()


def test_gaps_take_the_entitys_own_values(spark, folder):
    p = lagged_panel(spark, folder).withColumn("wind_speed", F.when(F.col("k") % 3 == 0, F.col("wind_speed") + 1))
    filled = feature_matrix(p, "train", fill_gaps=True)
    known = {r[0] for r in p.where("wind_speed IS NOT NULL").select("hospital_id").distinct().collect()}
    got = filled.groupBy("hospital_id").agg(F.min("wind_speed")).collect()
    assert len(got) > 20 and all((low > 0) == (h in known) for h, low in got)
    assert feature_matrix(p, "train").where("wind_speed = 0").count() == p.where("wind_speed IS NULL").count()


def test_serve_profile_without_lags(spark, folder):
    p = panel(spark, folder)
    with_entity = features(p, "serve").where("rolling_aqi IS NOT NULL")
    assert with_entity.count() == p.count()
    without = features(p.drop("hospital_id"), "serve")
    assert without.where("lag1_aqi <> aqi OR rolling_aqi <> aqi").count() == 0


def test_profiles_disagree_where_they_should(spark):
    row = spark.createDataFrame([(dt.date(2024, 12, 30), 200.0, 30.0, 50.0, 40.0, 80.0, 0.4, 1, 100.0, 90.0, 95.0, 1)],
        "date date, aqi double, temp double, humidity double, rainfall double, mobility_index double, outbreak_index double, is_weekend int, "
        "lag_1_admissions double, lag_7_admissions double, rolling_14_admissions double, hospital_id int")
    train, serve = features(row, "train").first(), features(row, "serve").first()
    assert (train["season"], serve["season"], train["week_of_year"]) == (1, 0, 1)
    assert train["aqi_respiratory_ratio"] == pytest.approx(260.0) and serve["aqi_respiratory_ratio"] == 200.0
    assert train["aqi_mobility"] == pytest.approx(40.0) and serve["aqi_mobility"] == 16000.0
    assert train["lag7_outbreak"] == pytest.approx(126.0) and serve["lag7_outbreak"] == pytest.approx(90.36)
    assert train["rainfall_injury_risk"] == 60.0 and serve["rainfall_injury_risk"] == 40.0


def test_missing_air_quality_fails_before_a_job(spark):
    with pytest.raises(ValueError, match="aqi"):
        features(spark.createDataFrame([(dt.date(2025, 1, 1),)], "date date"))


def test_scaling_uses_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, c double")
    assert [tuple(r) for r in scale_features(df, ["a", "c"]).orderBy("a").collect()] == [(-1.0, 0.0), (1.0, 0.0)]


def test_marks_follow_the_day_number(spark):
    for n, mark in ((111 * 6653, 1.0), (37 * 19961, 0.4), (111 * 6653 + 1, 0.0)):
        day = dt.date.fromordinal(n)
        assert spark.createDataFrame([(day,)], "d date").select(periodic_mark(F.col("d"))).first()[0] == mark


def test_filled_table_is_written_once_without_gaps_and_empty_tables_end(spark, monkeypatch):
    names, real = [], M.via_table
    monkeypatch.setattr(M, "via_table", lambda df, name, *rest: names.append(name) or real(df, name, *rest))
    days = [(h, dt.date(2024, 1, d), float(d), 20.0, 50.0, 1.0, 2.0, 60.0, 0.0, 0) for h in (1, 2) for d in (1, 2, 3)]
    df = spark.createDataFrame(days, "hospital_id int, date date, aqi double, temp double, humidity double, rainfall double, wind_speed double, mobility_index double, outbreak_index double, is_weekend int")
    assert M.filled_matrix(df).count() == 6 and names == ["features"]
    holed = df.withColumn("temp", F.when(F.dayofmonth("date") != 2, F.col("temp")))
    assert M.filled_matrix(holed).where("temp = 20").count() == 6
    assert M.filled_matrix(df.limit(0)).isEmpty() and M.filled_matrix(df.where("false")).isEmpty()
