import datetime as dt
import itertools

import numpy as np
import pytest

from wardcast.operators import percity
from wardcast.session import via_table

START = dt.date(2025, 1, 1)


@pytest.fixture(scope="module")
def data(spark):
    """Three cities, one of them without a name and one tiny; z2 is a combination of others, z3 is constant; some values are missing."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(900):
        x, z = rng.uniform(0, 10), rng.uniform(0, 1)
        y = 3 * x + 20 * (z > 0.7) - 4 * z + rng.normal(0, 2 + x / 5)
        city = "one" if i % 3 else None
        rows.append((city, i % 11, START + dt.timedelta(days=i // 7), float(x), float(z), 2 * x - z, 5.0, float(y)))
    rows += [("one", 1, START, None, 1.0, 1.0, 5.0, 1.0), ("one", 2, START, float("nan"), 1.0, 1.0, 5.0, 1.0), ("tiny", 1, START, 1.0, 1.0, 1.0, 5.0, 1.0)]
    return via_table(spark.createDataFrame(rows, "city string, hospital_id int, date date, x double, z double, z2 double, z3 double, y double").repartition(5), "sample")


NAMES = ["x", "z", "z2", "z3"]


def parts(data):
    local = data.toPandas()
    local["city"] = local.city.where(local.city.notna(), None)
    return {c: local[local.city.isna() if c is None else local.city == c].dropna(subset=["x"]) for c in (None, "one")}


def test_least_squares_equals_numpy_with_dependent_and_missing_inputs(data):
    fits = {r["city"]: r for r in percity.least_squares(data, NAMES, "y").collect()}
    for city, part in parts(data).items():
        a = np.column_stack([np.ones(len(part)), part.x, part.z])
        expected = np.linalg.lstsq(a, part.y, rcond=None)[0]
        own = fits[city]
        assert own["n_rows"] == len(part) and [own["intercept"], *own["coefficients"][:2]] == pytest.approx(list(expected), rel=1e-9)
        assert own["coefficients"][2:] == [0.0, 0.0]
    assert fits["one"]["n_left_out"] == 2
    assert fits["tiny"]["status"] == "error" and "rows" in fits["tiny"]["error"] and fits["tiny"]["coefficients"] is None
    scored = percity.predict(data, percity.least_squares(data, NAMES, "y"), NAMES)
    assert scored.count() == data.count() and scored.where("city = 'tiny' AND median IS NOT NULL").isEmpty()


def test_an_empty_table_has_no_fits(data):
    none = data.limit(0)
    assert percity.least_squares(none, NAMES, "y").isEmpty() and percity.quantile_fits(none, ["x"], "y").isEmpty()
    assert percity.cross_validate(none, ["x"], "y").isEmpty()


def test_rising_effects_are_the_best_of_all_subsets():
    rng = np.random.default_rng(3)
    for _ in range(30):
        x = np.column_stack([np.ones(60), rng.normal(size=(60, 4)) @ rng.normal(size=(4, 4))])
        y = x @ rng.normal(size=5) + rng.normal(size=60)
        rising = [1, 3, 4]
        b = percity.solved(x.T @ x, x.T @ y, rising)
        best = np.inf
        for out in itertools.chain.from_iterable(itertools.combinations(rising, k) for k in range(4)):
            kept = [j for j in range(5) if j not in out]
            c = np.zeros(5)
            c[kept] = np.linalg.lstsq(x[:, kept], y, rcond=None)[0]
            if (c[rising] >= -1e-12).all():
                best = min(best, np.square(y - x @ c).sum())
        assert (b[rising] >= 0).all() and np.square(y - x @ b).sum() == pytest.approx(best, rel=1e-9)


def test_quantile_fits_reach_the_loss_of_the_best_line(data):
    """The best line of a linear program runs through two points; all pairs of a few points are tried."""
    few = data.where("x IS NOT NULL AND NOT isnan(x)").where("city IS NULL AND hospital_id < 4")
    own = few.toPandas()
    fits = {r["level"]: r for r in percity.quantile_fits(few, ["x"], "y").collect()}
    x, y = own.x.to_numpy(), own.y.to_numpy()
    i, j = np.triu_indices(len(x), 1)
    slope = (y[i] - y[j]) / (x[i] - x[j])
    rest = y[None, :] - (y[i] - slope * x[i])[:, None] - slope[:, None] * x[None, :]
    for level, fit in fits.items():
        best = np.maximum(level * rest, (level - 1) * rest).mean(1).min()
        r = y - fit["intercept"] - fit["coefficients"][0] * x
        loss = np.maximum(level * r, (level - 1) * r).mean()
        assert fit["status"] == "ok" and fit["gap"] <= 1e-9 and loss == pytest.approx(fit["loss"], abs=1e-9)
        assert best - 1e-9 <= loss <= best * 1.01


def test_quantile_fits_keep_rows_of_entities_that_cannot_be_fitted(data):
    flat = data.where("city = 'tiny' OR city = 'one'").withColumn("y", data["x"] * 0 + 4)
    fits = percity.quantile_fits(flat, ["x", "z2", "z3"], "y", levels=[0.5]).collect()
    found = {r["city"]: r for r in fits}
    assert found["tiny"]["status"] == "error" and found["tiny"]["coefficients"] is None
    assert found["one"]["status"] == "ok" and found["one"]["intercept"] == pytest.approx(4) and found["one"]["loss"] == 0


def test_folds_equal_fits_of_the_rows_before_them(data):
    found = {(r["city"], r["fold"]): r for r in percity.cross_validate(data, ["x", "z"], "y").collect()}
    import hashlib

    every = data.toPandas()
    for city in (None, "one"):
        part = every[every.city.isna() if city is None else every.city == city].copy()
        part["tie"] = [hashlib.md5(str(h).encode()).hexdigest() for h in part.hospital_id]
        part = part.sort_values(["date", "tie", "hospital_id"], kind="stable").reset_index(drop=True)
        n, size = len(part), len(part) // 4
        for fold in (1, 2, 3):
            cut = n - (4 - fold) * size
            train, held = part[:cut].dropna(subset=["x"]), part[cut:cut + size].dropna(subset=["x"])
            a = lambda p: np.column_stack([np.ones(len(p)), p.x, p.z])
            b = np.linalg.lstsq(a(train), train.y, rcond=None)[0]
            own = found[city, fold]
            assert own["n_train"] == len(train) and own["n_validation"] == len(held)
            assert own["mae"] == pytest.approx(np.abs(held.y - a(held) @ b).mean(), rel=1e-9)
    assert found["tiny", 1]["status"] == "error" and found["tiny", 1]["mae"] is None


def test_a_constant_has_no_spread_and_no_moment_however_tasks_add_up(spark):
    """Of 49 ones, the mean of merged sums is not exactly 1, so the next part adds a deviation."""
    from wardcast.catalog.percity import _moments
    from wardcast.fixed_values import FEATURES

    rows = spark.range(0, 4 * 49, 1, 4).selectExpr("'one' AS city", *[f"1.0D AS `{c}`" for c in FEATURES], "CAST(id AS DOUBLE) AS v")
    assert {r["moment"] for r in _moments(rows, "v").collect()} == {0.0}
    assert percity.scales(rows, FEATURES[:2])[1].tolist() == [1.0, 1.0]


def test_rows_beside_their_fits_are_not_shuffled_by_entity(data):
    """Five cities would be five tasks, whatever the size of the table."""
    fits = percity.least_squares(data, NAMES, "y")
    plan = percity.predict(data, fits, NAMES)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan
