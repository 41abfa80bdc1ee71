import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from wardcast.fixed_values import FEATURES
from wardcast.operators import models as L
from wardcast.operators.metrics import quantile_hit_rate, regression_metrics
from wardcast.plans.requests import checked_requests, forecast_requests, plan_requests
from wardcast.plans.tables import lagged_panel, plan_parts
from wardcast.plans.training import forecast, train_global
from wardcast.session import scratch_path, via_table


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    x, z = rng.uniform(0, 10, 1500), rng.uniform(0, 1, 1500)
    y = 3 * x + 20 * (z > 0.7) + rng.normal(0, 2 + x / 5, 1500)
    rows = [(float(a), float(b), float(c), f"c{i % 3}") for i, (a, b, c) in enumerate(zip(x, z, y))]
    return via_table(spark.createDataFrame(rows, "x double, z double, y double, city string"), "sample")


def test_boosting_beats_the_mean_and_reloads(spark, data):
    model = L.fit_median(data, "squared", label="y", features=["x", "z"], iterations=8, depth=3)
    r2 = regression_metrics(model.transform(data), "y", "q50").first()["r2"]
    assert r2 > 0.5
    path = L.persist_model(model, scratch_path(spark, "m"))
    again = L.load_persisted_model(spark, path + "-gone", path)
    pair = model.transform(data).select("x", "z", "q50").exceptAll(again.transform(data).select("x", "z", "q50"))
    assert pair.count() == 0
    assert L.load_persisted_model(spark, path + "-gone") is None


def test_quantile_boosting_is_calibrated(spark, data):
    vectors = VectorAssembler(inputCols=["x", "z"], outputCol="features").transform(data)
    out = vectors
    for name, level in (("q10", 0.1), ("q90", 0.9)):
        out = L.fit_quantile(vectors, level, "y", rounds=4, depth=3).transform(out, name)
    hit = quantile_hit_rate(out, columns=["q10", "q90"]).first()
    assert abs(hit["hit_q10"] - 0.1) < 0.06 and abs(hit["hit_q90"] - 0.9) < 0.06
    assert out.where("q10 > q90").count() < 30


def test_searches_assemble_once(data, monkeypatch):
    written, real = [], L.via_table
    monkeypatch.setattr(L, "via_table", lambda df, name, *rest: written.append(name) or real(df, name, *rest))
    L.search(data.where("x < 8"), data.where("x >= 8"), {"depth": [1, 2]}, 2, "y", ["x", "z"])
    assert written == ["vectors", "vectors"]


def test_tuning_ranks_by_validation_error(data):
    ranked = L.tune(data.where("x < 8"), data.where("x >= 8"), {"depth": [1, 3], "iterations": [2]}, "y", ["x", "z"])
    assert len(ranked) == 2 and ranked[0]["mae"] <= ranked[1]["mae"]


def test_training_end_to_end(spark, folder):
    panel = via_table(lagged_panel(spark, folder), "panel")
    models = train_global(panel, iterations=3, depth=3)
    assert set(FEATURES) <= set(models.data.columns)
    done = forecast(models, models.data)
    assert done.count() == panel.count()
    assert done.where("lower > median OR median > upper").count() == 0


def test_requests_to_plans(spark, folder, tmp_path):
    """Request files, checks, forecasts with the trained models, alerts and plans."""
    panel = via_table(lagged_panel(spark, folder), "panel")
    models = train_global(panel, iterations=2, depth=2)
    rows = panel.withColumns({
        "request_id": F.concat_ws("/", F.col("hospital_id").cast("string"), F.date_format("date", "yyyy")),
        "mode": F.when(F.col("hospital_id") == 3, F.lit("wrong")).otherwise(F.lit("tft")), "weight_tft": F.lit(0.5), "disease_sensitivity": F.lit(0.9),
    })
    good, bad = checked_requests(rows)
    assert good.count() + bad.count() == rows.count() and bad.where("hospital_id <> 3").count() == 0 and bad.count() > 0
    bands = forecast_requests(good, models)
    assert bands.count() == good.count() and bands.where("median IS NULL OR lower IS NULL").count() == 0
    parts = plan_parts(good, ["request_id", "hospital_id", "date"])
    plans = plan_requests(bands, *parts, F.to_timestamp(F.lit("2025-01-01 00:00:00")))
    assert plans.count() == good.count()
    assert plans.select("plan.requestId").distinct().count() == good.count()


def test_search_stages_equal_separate_fits_and_halving_keeps_the_best(data):
    train, later = data.where("x < 8"), data.where("x >= 8")
    trials = L.search(train, later, {"depth": [1, 2], "rate": [0.1, 0.5]}, trees=8, label="y", features=["x", "z"])
    assert [t.rung for t in trials] == [2, 1, 0, 0] and [t.trees for t in trials] == [8, 4, 2, 2]
    for t in trials[:2]:
        model = L.boosted("squared", "y", "p", ["x", "z"], iterations=t.best, **t.options).fit(train)
        assert model.transform(later).agg(F.avg(F.abs(F.col("y") - F.col("p")))).first()[0] == pytest.approx(t.error, abs=1e-9)
        assert len(t.errors) == t.trees and t.error == min(t.errors)
    # a rung keeps the half with the smaller errors
    assert min(t.errors[:2][-1] for t in trials[:2]) <= min(t.error for t in trials[2:]) + 1e-9


def test_quantile_fit_stops_early_and_keeps_the_best_trees(data):
    vectors = VectorAssembler(inputCols=["x", "z"], outputCol="features").transform(data)
    train, later = vectors.where("x < 8"), vectors.where("x >= 8")
    whole = L.fit_quantile(train, 0.9, "y", rounds=7, depth=2, rate=0.9)
    losses = whole.staged_losses(later, "y")
    assert len(losses) == 8
    for n in (0, 3):
        gap = F.col("y") - F.col("p")
        assert whole.first(n).transform(later, "p").agg(F.avg(L.pinball(gap, 0.9))).first()[0] == pytest.approx(losses[n], abs=1e-9)
    early = L.fit_quantile(train, 0.9, "y", rounds=7, depth=2, rate=0.9, validation=later, patience=2)
    stop = next((i for i in range(2, 8) if min(losses[:i + 1]) < min(losses[i - 1:i + 1])), 7)
    assert len(early.steps) == losses[:stop + 1].index(min(losses[:stop + 1]))


def test_a_saved_set_is_whole_or_the_one_before(spark, folder, monkeypatch):
    """A second set without a spike stage does not meet the first one's; a write that breaks off leaves the old set."""
    from wardcast.plans import training

    panel = via_table(lagged_panel(spark, folder), "panel")
    models = train_global(panel, iterations=2, depth=2)
    models.extreme = None
    where = scratch_path(spark, "models")
    with pytest.raises(FileNotFoundError):
        training.load_models(spark, where)
    training.save_models(models, where)
    first = training.load_models(spark, where)
    assert first.spike is not None and first.extreme is None and first.offsets == models.offsets
    models.spike, models.offsets = None, {"q10": -1.0, "q90": 1.0}
    kept, calls = training.persist_model, []

    def broken(model, path):
        calls.append(path)
        if len(calls) == 2:
            raise OSError("stopped")
        return kept(model, path)

    monkeypatch.setattr(training, "persist_model", broken)
    with pytest.raises(OSError):
        training.save_models(models, where)
    monkeypatch.setattr(training, "persist_model", kept)
    assert training.load_models(spark, where).spike is not None
    training.save_models(models, where)
    last = training.load_models(spark, where)
    assert last.spike is None and last.second is not None and last.offsets == models.offsets
    assert training.load_models(spark, where, version=1).spike is not None


def test_entries_are_written_once_and_broken_ones_do_not_count(spark):
    from wardcast.sources.ledger import enter, entries

    where = scratch_path(spark, "ledger")
    assert entries(spark, where) == {}
    assert enter(spark, where, 3, {"a": 1}) and not enter(spark, where, 3, {"a": 2}) and enter(spark, where, 1, {"b": "é"})
    assert entries(spark, where) == {1: {"b": "é"}, 3: {"a": 1}}
    assert enter(spark, where, 3, {"a": 2}, replace=True)
    with open(f"{where.removeprefix('file:')}/0000000009.json", "w") as broken:
        broken.write('{"a"')
    assert entries(spark, where) == {1: {"b": "é"}, 3: {"a": 2}}
