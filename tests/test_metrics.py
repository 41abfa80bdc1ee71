import pytest

from wardcast.operators import metrics as M


def frame(spark, rows):
    return spark.createDataFrame([tuple(map(float, r)) for r in rows], "y double, median double")


def test_values(spark):
    r = M.regression_metrics(frame(spark, [(10, 12), (20, 18), (30, 33)])).first()
    assert (r["mae"], r["rmse"], r["r2"], r["accuracy"]) == (2.3333, 2.3805, 0.915, 88.33)


def test_mean_zero_constant_and_empty(spark):
    zero = M.regression_metrics(frame(spark, [(-1, 0), (1, 0)])).first()
    assert (zero["mae"], zero["accuracy"]) == (1.0, 0.0)
    constant = M.regression_metrics(frame(spark, [(5, 4), (5, 6)])).first()
    assert constant["r2"] is None and constant["accuracy"] == 80.0
    assert M.regression_metrics(frame(spark, [(1, 1)]).limit(0), raw=True).first()["mae"] is None


def test_spike_metrics_skip_when_there_are_none(spark):
    assert M.spike_metrics(frame(spark, [(5, 4), (5, 4), (5, 4)])).count() == 0
    r = M.spike_metrics(frame(spark, [(1, 1), (2, 2), (3, 3), (9, 5)])).first()
    assert (r["n_spikes"], r["spike_mae"], r["underprediction_pct"], r["threshold"]) == (1, 4.0, 100.0, 4.5)


def test_coverage_hits_and_pinball(spark):
    df = spark.createDataFrame([(5.0, 1.0, 9.0), (5.0, 6.0, 9.0), (5.0, 5.0, 5.0), (5.0, 1.0, 4.0)], "y double, lower double, upper double")
    assert tuple(M.quantile_coverage(df).first()) == (0.5, 50.0)
    assert M.quantile_hit_rate(df, columns=["upper"]).first()[0] == 0.75
    assert M.pinball_loss(df, {"lower": 0.1}).first()[0] == pytest.approx((0.4 + 0.9 + 0 + 0.4) / 4)
