"""Splits, weights, model fits and persistence."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardcast.catalog.bands import FOLDS_SQL
from wardcast.catalog.registry import query
from wardcast.functions.fixed import fixed_row
from wardcast.functions.scalars import flag
from wardcast.operators import models as L
from wardcast.operators.ordering import expanding_folds, time_split
from wardcast.operators.quantiles import quantiles
from wardcast.operators.weights import extreme_weights, residuals, spike_weights
from wardcast.plans.tables import FORECAST_SQL, LAGGED_SQL, PANEL_SQL, lagged_panel, raw_forecast, stored_forecast, stored_panel
from wardcast.plans.training import forecast, load_models, prepare, save_models, train_global, training_summary
from wardcast.session import scratch_path, via_table

KEY = "hospital_id::BIGINT AS hospital_id, CAST(date AS VARCHAR) AS date"
ORDER = "date, md5(CAST(hospital_id AS VARCHAR)), hospital_id"


def split_sql(source: str) -> str:
    return f""",
cut AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY {ORDER}) <= CAST(floor(count(*) OVER () * CAST(0.85 AS DOUBLE)) AS BIGINT) THEN 'train' ELSE 'validation' END AS split FROM {source})"""


@query("time_split", f"WITH {PANEL_SQL}{split_sql('panel')} SELECT {KEY}, split FROM cut")
def split(spark, folder):
    return time_split(stored_panel(spark, folder)).select("hospital_id", "date", "split")


@query("expanding_cv_folds", f"WITH {FORECAST_SQL}{FOLDS_SQL} SELECT {KEY}, fold::BIGINT AS fold, part FROM folds WHERE part IS NOT NULL")
def folds(spark, folder):
    return expanding_folds(stored_forecast(spark, folder)).select("hospital_id", "date", "fold", "part")


@query("residuals", f"WITH {FORECAST_SQL} SELECT {KEY}, round(y - second, 9) AS residual FROM pred")
def residual(spark, folder):
    return residuals(raw_forecast(spark, folder), "y", "second").select("hospital_id", "date", F.round("residual", 9).alias("residual"))


RESIDUAL_SQL = FORECAST_SQL + ", res AS (SELECT *, round(y - second, 9) AS residual FROM pred)"


def with_residual(spark, folder):
    return residuals(stored_forecast(spark, folder), "y", "second").withColumn("residual", F.round("residual", 9))


@query("spike_weights", f"""WITH {RESIDUAL_SQL},
q AS (SELECT quantile_cont(y, 0.7) AS y70, quantile_cont(abs(residual), 0.85) AS a85, quantile_cont(abs(residual), 0.95) AS a95, quantile_cont(abs(residual), 0.99) AS a99,
  quantile_cont(residual, 0.9) FILTER (WHERE residual > 0) AS g90 FROM res)
SELECT {KEY}, CAST(CASE WHEN y > y70 THEN 15.0 ELSE 1.0 END * CASE WHEN abs(residual) > a85 THEN 2.0 ELSE 1.0 END * CASE WHEN abs(residual) > a95 THEN 2.0 ELSE 1.0 END
  * CASE WHEN abs(residual) > a99 THEN 2.0 ELSE 1.0 END * CASE WHEN residual > 0 THEN 1.5 ELSE 1.0 END * CASE WHEN residual > g90 THEN 1.5 ELSE 1.0 END AS DOUBLE) AS weight
FROM res, q WHERE (SELECT count(*) FROM res, q WHERE y > y70) >= 25""")
def weights_of_spikes(spark, folder):
    """No rows where there are too few spikes to weight."""
    return spike_weights(with_residual(spark, folder)).where("weight IS NOT NULL").select("hospital_id", "date", "weight")


@query("extreme_weights", f"""WITH {RESIDUAL_SQL}, q AS (SELECT quantile_cont(residual, 0.99) FILTER (WHERE residual > 0) AS g99 FROM res),
r AS (SELECT *, row_number() OVER (ORDER BY residual DESC, hospital_id, date) AS n, count(*) FILTER (WHERE residual > g99) OVER () AS extremes FROM res, q)
SELECT {KEY}, CAST(CASE WHEN n <= 5 AND extremes > 5 THEN 500 WHEN residual > g99 THEN 200 ELSE 1 END AS DOUBLE) AS weight FROM r WHERE extremes >= 10""")
def weights_of_extremes(spark, folder):
    """No rows where there are too few extremes to weight."""
    return extreme_weights(with_residual(spark, folder)).where("weight IS NOT NULL").select("hospital_id", "date", "weight")


@query("residual_bands", f"""WITH {RESIDUAL_SQL}, q AS (SELECT city, quantile_cont(y - second, 0.1) AS r10, quantile_cont(y - second, 0.9) AS r90 FROM pred GROUP BY 1)
SELECT {KEY}, round(second + r10, 6) AS low, round(second + r90, 6) AS high FROM pred JOIN q ON pred.city = q.city""")
def bands(spark, folder):
    f = stored_forecast(spark, folder)
    done = L.residual_bands(f, f, "y", "second", {"low": 0.1, "high": 0.9}, ["city"])
    return done.select("hospital_id", "date", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("training_summary", f"""WITH {FORECAST_SQL}{split_sql('pred')}, v AS (SELECT * FROM cut WHERE split = 'validation')
SELECT 41::BIGINT AS n_features, CAST(count(*) FILTER (WHERE split = 'train') AS BIGINT) AS n_train, CAST(count(*) FILTER (WHERE split = 'validation') AS BIGINT) AS n_val,
  count(DISTINCT city) AS n_cities, count(DISTINCT hospital_id) AS n_hospitals, (SELECT round(avg(abs(y - second)), 4) FROM v) AS mae,
  (SELECT round(sqrt(avg((y - second) * (y - second))), 4) FROM v) AS rmse, (SELECT round(1 - avg((y - second) * (y - second)) / var_pop(y), 4) FROM v) AS r2,
  (SELECT round(greatest(0, (1 - avg(abs(y - second)) / avg(y)) * 100), 2) FROM v) AS accuracy,
  (SELECT round(avg(CASE WHEN y BETWEEN q10 AND q90 THEN 1.0 ELSE 0.0 END), 6) FROM v) AS coverage,
  (SELECT round(avg(CASE WHEN y BETWEEN q10 AND q90 THEN 1.0 ELSE 0.0 END) * 100, 2) FROM v) AS coverage_pct FROM cut""")
def summary(spark, folder):
    data = time_split(stored_forecast(spark, folder))
    scored = data.where("split = 'validation'").select("y", F.col("q10").alias("lower"), F.col("second").alias("median"), F.col("q90").alias("upper"))
    return training_summary(data, scored).withColumn("coverage", F.round("coverage", 6))


def _prepared(spark, folder):
    return prepare(via_table(lagged_panel(spark, folder), "panel"))


CUT_SQL = LAGGED_SQL + split_sql("lagged")
MEAN_SQL = CUT_SQL + ", c AS (SELECT avg(admissions) AS m FROM cut WHERE split = 'train')"
#: Rows of each part, the error of the best constant there, and whether the fit has a smaller one on the rows it saw.
FIT_SQL = f"""WITH {MEAN_SQL}
SELECT split, count(*) AS n_rows, round(sqrt(avg((admissions - m) * (admissions - m))), 6) AS constant_rmse, CASE WHEN split = 'train' THEN 1 ELSE 0 END::BIGINT AS better FROM cut, c GROUP BY split"""


def _against_constant(scored, column):
    mean = fixed_row(scored.where("split = 'train'").agg(F.avg("admissions").alias("m")))["m"]

    def rmse(value):
        return F.sqrt(F.avg((F.col("admissions") - value) * (F.col("admissions") - value)))

    both = scored.groupBy("split").agg(F.count("*").alias("n_rows"), rmse(mean).alias("constant_rmse"), rmse(F.col(column)).alias("rmse"))
    return both.select("split", "n_rows", F.round("constant_rmse", 6).alias("constant_rmse"), flag((F.col("split") == "train") & (F.col("rmse") < F.col("constant_rmse"))).alias("better"))


@query("fit_median_squared", FIT_SQL)
def median_squared(spark, folder):
    data = _prepared(spark, folder).withColumn("__val", F.col("split") == "validation")
    return _against_constant(L.fit_median(data, "squared", validation="__val").transform(data), "q50")


@query("fit_median_absolute", FIT_SQL)
def median_absolute(spark, folder):
    data = _prepared(spark, folder).withColumn("__val", F.col("split") == "validation")
    return _against_constant(L.fit_median(data, "absolute", validation="__val").transform(data), "q50")


@query("fit_second_model", FIT_SQL)
def second_model(spark, folder):
    data = _prepared(spark, folder)
    return _against_constant(L.fit_second_model(data.where("split = 'train'")).transform(data), "second")


def _loss_sql(level: str) -> str:
    return f"round(avg(greatest({level} * (admissions - v), ({level} - 1) * (admissions - v))), 6)"


@query("fit_quantile", f"""WITH {CUT_SQL}, q AS (SELECT unnest([0.1, 0.9])::DOUBLE AS level),
c AS (SELECT 0.1::DOUBLE AS level, quantile_cont(admissions, 0.1) AS v FROM cut WHERE split = 'train' UNION ALL SELECT 0.9, quantile_cont(admissions, 0.9) FROM cut WHERE split = 'train')
SELECT level, split, count(*) AS n_rows, {_loss_sql('level')} AS constant_loss, CASE WHEN split = 'train' THEN 1 ELSE 0 END::BIGINT AS better FROM cut, c GROUP BY level, split""")
def pinball(spark, folder):
    """Pinball losses of the best constant, and whether the model's is smaller on its training rows."""
    data = via_table(L.assembled(_prepared(spark, folder), keep=["hospital_id", "date", "split", "admissions"]), "vectors")
    train, out = data.where("split = 'train'"), None
    for level in (0.1, 0.9):
        constant = F.lit(quantiles(train, {"y": F.col("admissions")}, [level]).first()["q"][0])
        scored = L.fit_quantile(train, level).transform(data, "q")

        def loss(value, level=level):
            gap = F.col("admissions") - value
            return F.avg(F.greatest(level * gap, (level - 1) * gap))

        part = scored.groupBy("split").agg(F.lit(level).alias("level"), F.count("*").alias("n_rows"), loss(constant).alias("constant_loss"), loss(F.col("q")).alias("loss"))
        out = part if out is None else out.unionByName(part)
    better = flag((F.col("split") == "train") & (F.col("loss") < F.col("constant_loss")))
    return out.select("level", "split", "n_rows", F.round("constant_loss", 6).alias("constant_loss"), better.alias("better"))


#: Spike rows have many times the weight, so the corrected residuals must be smaller than the plain ones under these weights.
BOOSTER_SQL = f"""WITH {CUT_SQL} SELECT split, count(*) AS n_rows, CASE WHEN split = 'train' THEN 1 ELSE 0 END::BIGINT AS no_worse FROM cut GROUP BY split"""


def _scored(spark, folder):
    data = _prepared(spark, folder)
    median = L.fit_median(data.where("split = 'train'"))
    rows = L.assembled(data, keep=["hospital_id", "date", "split", "admissions"])  # assembled inputs stay for the next fit
    return via_table(residuals(L.applied(median, rows), "admissions", "q50"), "scored")


def _corrections(scored, weighted, model, column):
    """Weighted squared residuals of the training rows without and with the correction (equal where there is none)."""
    moved = L.applied(model, weighted) if model else weighted.withColumns({column: F.lit(0.0), "weight": F.lit(1.0)})
    size = moved.agg(F.sum(F.col("weight") * F.pow("residual", F.lit(2))).alias("plain"), F.sum(F.col("weight") * F.pow(F.col("residual") - F.col(column), F.lit(2))).alias("moved"))
    sizes = fixed_row(size)
    return scored.groupBy("split").agg(F.count("*").alias("n_rows")).withColumn(
        "no_worse", flag((F.col("split") == "train") & (sizes["moved"] <= sizes["plain"])))


@query("fit_spike_booster", BOOSTER_SQL)
def spike_booster(spark, folder):
    scored = _scored(spark, folder)
    weighted = spike_weights(scored.where("split = 'train'"), "admissions")
    return _corrections(scored, weighted, L.fit_spike_booster(weighted), "spike")


@query("fit_extreme_booster", BOOSTER_SQL)
def extreme_booster(spark, folder):
    scored = _scored(spark, folder)
    weighted = extreme_weights(scored.where("split = 'train'"))
    return _corrections(scored, weighted, L.fit_extreme_booster(weighted), "extreme")


GRID_SQL = "SELECT depth::BIGINT AS depth, rate FROM (SELECT unnest([3, 5]) AS depth), (SELECT unnest([0.1, 0.3])::DOUBLE AS rate)"


@query("tune", f"""WITH {CUT_SQL}, c AS (SELECT quantile_cont(admissions, 0.5) AS m FROM cut WHERE split = 'train'), g AS ({GRID_SQL})
SELECT depth, rate, n_rows, constant_mae, 1::BIGINT AS stages_in_range, 1::BIGINT AS ranked FROM g, (SELECT count(*) AS n_rows, round(avg(abs(admissions - m)), 6) AS constant_mae FROM cut, c WHERE split = 'validation')""")
def tuned(spark, folder):
    """All combinations, ranked on the validation rows; the median's error there beside them."""
    data = _prepared(spark, folder)
    train, validation = data.where("split = 'train'"), data.where("split = 'validation'")
    ranked = L.search(train, validation, {"depth": [3, 5], "rate": [0.1, 0.3]})
    middle = F.lit(quantiles(train, {"y": F.col("admissions")}, [0.5]).first()["q"][0])
    sizes = fixed_row(validation.agg(F.count("*").alias("n_rows"), F.round(F.avg(F.abs(F.col("admissions") - middle)), 6).alias("constant_mae")))
    order = [(-t.rung, t.error) for t in ranked]
    rows = [(*t.options.values(), int(1 <= t.best <= t.trees == len(t.errors)), int(order == sorted(order))) for t in ranked]
    return spark.createDataFrame(rows, "depth int, rate double, stages_in_range int, ranked int").withColumns({c: sizes[c] for c in ("n_rows", "constant_mae")})


@query("tune_staged", f"""WITH {CUT_SQL} SELECT part, count(*) AS n_rows, 0.0::DOUBLE AS difference FROM cut, (SELECT unnest(['median', 'q90']) AS part) WHERE split = 'validation' GROUP BY 1""")
def staged(spark, folder):
    """The winners of two searches, for the median by absolute error and for the 90 % quantile by its own loss: the error of the best number of trees less
    that of a separate fit of so many trees, over the validation rows."""
    data = via_table(L.assembled(_prepared(spark, folder), keep=["admissions", "split"]), "vectors", ["split"])
    train, validation = data.where("split = 'train'"), data.where("split = 'validation'")
    out = []
    best = L.search(train, validation, {"depth": [3, 5], "rate": [0.3]}, trees=8)[0]
    alone = L.applied(L.fitted(L.boosted("squared", prediction="p", iterations=best.best, **best.options), train), validation)
    out.append(("median", best.error, alone.agg(F.avg(F.abs(F.col("admissions") - F.col("p")))).first()[0]))
    best = L.search(train, validation, {"depth": [3], "rate": [0.3, 0.5]}, trees=4, level=0.9)[0]
    alone = L.fit_quantile(train, 0.9, rounds=best.best, **best.options).transform(validation, "p")
    out.append(("q90", best.error, alone.agg(F.avg(L.pinball(F.col("admissions") - F.col("p"), 0.9))).first()[0]))
    found = spark.createDataFrame(out, "part string, staged double, alone double").withColumn("n_rows", fixed_row(validation.agg(F.count("*").alias("n_rows")))["n_rows"])
    return found.select("part", "n_rows", (F.round(F.col("staged") - F.col("alone"), 9) + F.lit(0.0)).alias("difference"))


SAME_SQL = f"WITH {CUT_SQL} SELECT {KEY}, split, admissions, 0.0::DOUBLE AS difference"


@query("persist_model", f"{SAME_SQL} FROM cut")
def persisted(spark, folder):
    """Scores before saving less scores after loading, row by row."""
    data = _prepared(spark, folder)
    model = L.fit_second_model(data.where("split = 'train'"))
    path = L.persist_model(model, scratch_path(spark, "model"))
    before = model.transform(data).drop("features").withColumnRenamed("second", "before")
    after = L.load_persisted_model(spark, f"{path}-absent", path).transform(before)
    return after.select("hospital_id", "date", "split", "admissions", (F.col("second") - F.col("before")).alias("difference"))


@query("load_persisted_model", f"{SAME_SQL}, 0::BIGINT AS spike_model_found FROM cut")
def loaded(spark, folder):
    """A missing optional model is skipped; the older path is found instead."""
    data = _prepared(spark, folder)
    model = L.fit_second_model(data.where("split = 'train'"))
    path = L.persist_model(model, scratch_path(spark, "older"))
    optional = L.load_persisted_model(spark, f"{path}-spike")
    before = model.transform(data).drop("features").withColumnRenamed("second", "before")
    after = L.load_persisted_model(spark, f"{path}-new", path).transform(before)
    return after.select("hospital_id", "date", "split", "admissions", (F.col("second") - F.col("before")).alias("difference"), F.lit(int(optional is not None)).alias("spike_model_found"))


@query("persist_model_set", f"{SAME_SQL} FROM cut")
def saved_set(spark, folder):
    """Ensemble medians of a trained set less those of the set saved and loaded."""
    models = train_global(via_table(lagged_panel(spark, folder), "panel"))
    again = load_models(spark, save_models(models, scratch_path(spark, "models")))
    one, two = (forecast(m, models.data, keep=["split", "admissions"]) for m in (models, again))
    both = one.join(two.select("hospital_id", "date", F.col("median").alias("again")), ["hospital_id", "date"])
    return both.select("hospital_id", "date", "split", "admissions", (F.col("median") - F.col("again")).alias("difference"))


@query("train_and_forecast", f"WITH {CUT_SQL} SELECT split, count(*) AS n_rows, CAST(sum(admissions) AS BIGINT) AS admissions, 0::BIGINT AS out_of_order, 0::BIGINT AS not_scored FROM cut GROUP BY split")
def whole_run(spark, folder):
    """Training, scoring and ordering end to end: every row is scored, and none is out of order."""
    models = train_global(via_table(lagged_panel(spark, folder), "panel"))
    done = forecast(models, models.data, keep=["split", "admissions"])
    wrong = (F.col("lower") > F.col("median")) | (F.col("median") > F.col("upper"))
    gone = F.col("lower").isNull() | F.col("median").isNull() | F.col("upper").isNull()
    return done.groupBy("split").agg(F.count("*").alias("n_rows"), F.sum("admissions").alias("admissions"), F.count_if(wrong).alias("out_of_order"), F.count_if(gone).alias("not_scored"))
