import numpy as np
import pytest
from pyspark.sql import functions as F

from wardcast.operators import bands as B
from wardcast.operators.weights import extreme_weights, spike_weights
from wardcast.plans.tables import raw_forecast


def frame(spark, n, seed=1, spread=80.0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        q50 = float(rng.uniform(0, 3 * spread))
        rows.append((i, "d", q50 - 10, q50, q50 + 10, float(rng.uniform(-5, spread)), float(rng.uniform(-5, spread)), q50 * 0.9))
    return spark.createDataFrame(rows, "hospital_id int, date string, q10 double, q50 double, q90 double, spike double, extreme double, second double"), rows


def factor(value, values, shares, levels):
    """Row by row: the last bound that the value exceeds decides."""
    bounds = [(np.quantile(values, p), m) for p, m in shares] if len(values) > 10 else levels
    return max([1.0] + [m for bound, m in bounds if value > bound])


@pytest.mark.parametrize("n", [1, 10, 11, 200])
def test_scaling_switches_at_ten_rows(spark, n):
    df, rows = frame(spark, n)
    spikes, extremes = [r[5] for r in rows], [r[6] for r in rows]
    for r in B.scale_corrections(df).collect():
        assert r["spike_scaled"] == pytest.approx(r["spike"] * factor(r["spike"], spikes, [(0.9, 2), (0.95, 3), (0.99, 4)], [(30, 2), (60, 4)]))
        assert r["extreme_scaled"] == pytest.approx(r["extreme"] * factor(r["extreme"], extremes, [(0.9, 5), (0.95, 6.5), (0.99, 8)], [(20, 5), (40, 8)]))


@pytest.mark.parametrize("n", [3, 11, 60])
def test_widening(spark, n):
    df, _ = frame(spark, n)
    before = {r["hospital_id"]: r for r in B.apply_adjustment(B.scale_corrections(df)).collect()}
    medians = [r["q50"] for r in before.values()]
    limit = np.quantile(medians, 0.9) if n > 10 else 200
    for r in B.corrected(df).collect():
        width = before[r["hospital_id"]]["q90"] - before[r["hospital_id"]]["q10"]
        assert r["q90"] - r["q10"] == pytest.approx(width * 1.5 if r["q50"] > limit else width)


def test_no_widening_without_any_correction(spark):
    df, _ = frame(spark, 30)
    still = df.withColumns({"spike": F.lit(0.0), "extreme": F.lit(0.0)})
    assert B.corrected(still).where("abs((q90 - q10) - 20) > 1e-9").count() == 0


def test_batches_are_independent(spark):
    small, _ = frame(spark, 5, 2)
    large, _ = frame(spark, 40, 3)
    both = small.withColumn("req", F.lit("s")).unionByName(large.withColumn("req", F.lit("l")))
    joint = {(r["req"], r["hospital_id"]): (r["q10"], r["q50"], r["q90"]) for r in B.corrected(both, ["req"]).collect()}
    for name, df in (("s", small), ("l", large)):
        for r in B.corrected(df).collect():
            assert joint[name, r["hospital_id"]] == pytest.approx((r["q10"], r["q50"], r["q90"]))


def test_ensemble_bands_are_ordered(spark, folder):
    done = B.score_mode(raw_forecast(spark, folder), "ensemble")
    assert done.where("lower > median OR median > upper OR upper - lower < 0.1").count() == 0


def test_weight_on_the_second_model(spark):
    df, rows = frame(spark, 2)
    for w in (0.0, 0.6, 1.0):
        for r in B.blend_median(df, weight=w).collect():
            assert r["median"] == pytest.approx(w * r["second"] + (1 - w) * r["q50"])


def test_unknown_mode(spark):
    with pytest.raises(ValueError, match="mode"):
        B.score_mode(frame(spark, 2)[0], "other")


def training(spark, n, seed=5):
    rng = np.random.default_rng(seed)
    y, r = rng.uniform(0, 300, n).round(3), rng.normal(0, 20, n).round(3)
    df = spark.createDataFrame([(i, "d", float(a), float(b)) for i, (a, b) in enumerate(zip(y, r))], "hospital_id int, date string, y double, residual double")
    return df, y, r


def test_spike_weights(spark):
    df, y, r = training(spark, 400)
    size, gains = np.abs(r), r[r > 0]
    for row in spike_weights(df).collect():
        i = row["hospital_id"]
        expected = 15.0 if y[i] > np.quantile(y, 0.7) else 1.0
        expected *= 2.0 ** sum(size[i] > np.quantile(size, p) for p in (0.85, 0.95, 0.99))
        expected *= 1.5 ** (int(r[i] > 0) + int(r[i] > np.quantile(gains, 0.9)))
        assert row["weight"] == pytest.approx(expected)


def test_too_few_spikes_or_extremes_give_no_weights(spark):
    df, _, _ = training(spark, 40)
    assert spike_weights(df).where("weight IS NOT NULL").count() == 0
    assert extreme_weights(df).where("weight IS NOT NULL").count() == 0
    negative = df.withColumn("residual", -F.abs("residual") - 1)
    assert extreme_weights(negative).where("weight IS NOT NULL").count() == 0


def test_extreme_weights(spark):
    df, _, r = training(spark, 4000)
    got = {row["hospital_id"]: row["weight"] for row in extreme_weights(df).collect()}
    limit = np.quantile(r[r > 0], 0.99)
    top = set(np.argsort(r)[-5:])
    assert all(got[i] == (500.0 if i in top else 200.0 if r[i] > limit else 1.0) for i in range(len(r)))
