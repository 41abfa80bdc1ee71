"""Forecast bands and their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardcast.catalog.registry import query
from wardcast.operators import bands as B
from wardcast.operators import metrics as M
from wardcast.operators.ordering import expanding_folds
from wardcast.plans.tables import FORECAST_SQL, raw_forecast, stored_forecast

KEY = "hospital_id::BIGINT AS hospital_id, CAST(date AS VARCHAR) AS date"


def _times(value, stats, large, small):
    shares = " ".join(f"WHEN {value} > {stats}{i} THEN {m}" for i, m in reversed(list(enumerate(large))))
    levels = " ".join(f"WHEN {value} > {level} THEN {m}" for level, m in reversed(small))
    return f"CASE WHEN n > 10 THEN CASE {shares} ELSE 1.0 END ELSE CASE {levels} ELSE 1.0 END END"


SPIKE = _times("spike", "s", [2.0, 3.0, 4.0], [(30, 2.0), (60, 4.0)])
EXTREME = _times("extreme", "e", [5.0, 6.5, 8.0], [(20, 5.0), (40, 8.0)])


def scaled_sql(base: str = "pred", batch: str = "1") -> str:
    """CTEs that add the scaled corrections, relative to a batch expression."""
    cells = ", ".join(
        f"quantile_cont({c}, {p}) AS {k}{i}" for c, k in (("spike", "s"), ("extreme", "e")) for i, p in enumerate((0.9, 0.95, 0.99)))
    return f""",
st AS (SELECT {batch} AS b, count(*) AS n, {cells} FROM {base} GROUP BY 1),
scaled AS (SELECT p.*, b, spike * CAST({SPIKE} AS DOUBLE) AS spike_scaled, extreme * CAST({EXTREME} AS DOUBLE) AS extreme_scaled FROM {base} p JOIN st ON {batch} = b)"""


def widened_sql(margin: float = 0.0) -> str:
    low, high = (f"q10 - {margin}", f"q90 + {margin}") if margin else ("q10", "q90")
    return f""",
moved AS (SELECT * EXCLUDE (q10, q50, q90), 0.0 + spike_scaled + extreme_scaled AS adjustment, {low} + (0.0 + spike_scaled + extreme_scaled) AS q10,
  q50 + (0.0 + spike_scaled + extreme_scaled) AS q50, {high} + (0.0 + spike_scaled + extreme_scaled) AS q90 FROM scaled),
ms AS (SELECT b, count(*) AS n, quantile_cont(q50, 0.9) AS p90, bool_or(adjustment <> 0) AS adjusted FROM moved GROUP BY 1),
widened AS (SELECT m.* EXCLUDE (q10, q90),
  CASE WHEN adjusted AND (CASE WHEN n > 10 THEN q50 > p90 ELSE q50 > 200 END) THEN (q90 + q10) / 2 - (q90 - q10) * 0.75 ELSE q10 END AS q10,
  CASE WHEN adjusted AND (CASE WHEN n > 10 THEN q50 > p90 ELSE q50 > 200 END) THEN (q90 + q10) / 2 + (q90 - q10) * 0.75 ELSE q90 END AS q90
  FROM moved m JOIN ms ON m.b = ms.b)"""


def blend(weight: float = 0.6) -> str:
    return f"(CAST({weight} AS DOUBLE) * second + (CAST(1.0 AS DOUBLE) - CAST({weight} AS DOUBLE)) * q50)"


ENSEMBLE = f""",
banded AS (SELECT *, greatest(greatest(q90 + 1.5, median + 2.0), least(q10 - 1.5, median - 2.0) + CAST(0.1 AS DOUBLE)) AS upper, least(q10 - 1.5, median - 2.0) AS lower
  FROM (SELECT *, {blend()} AS median FROM widened))"""


def _six(df, *columns):
    return df.select("hospital_id", "date", *[F.round(c, 6).alias(c) for c in columns])


def _six_sql(*columns):
    return f"{KEY}, " + ", ".join(f"round({c}, 6) AS {c}" for c in columns)


for _name, _column in (("scale_spike_1", "spike"), ("scale_spike_2", "extreme")):
    @query(_name, f"WITH {FORECAST_SQL}{scaled_sql()} SELECT {_six_sql(_column, _column + '_scaled')} FROM scaled")
    def scale(spark, folder, column=_column):
        return _six(B.scale_corrections(stored_forecast(spark, folder), [column]), column, f"{column}_scaled")


@query("scale_spike_by_batch", f"WITH {FORECAST_SQL}{scaled_sql(batch='date')} SELECT {_six_sql('spike_scaled', 'extreme_scaled')} FROM scaled")
def scale_by_day(spark, folder):
    """Every day is one request: most days have fewer rows than the small-batch limit."""
    return _six(B.scale_corrections(stored_forecast(spark, folder), batch=["date"]), "spike_scaled", "extreme_scaled")


@query("apply_adjustment", f"WITH {FORECAST_SQL}{scaled_sql()}{widened_sql()} SELECT {_six_sql('adjustment', 'q10', 'q50', 'q90')} FROM moved")
def adjust(spark, folder):
    return _six(B.apply_adjustment(B.scale_corrections(stored_forecast(spark, folder))), "adjustment", "q10", "q50", "q90")


@query("widen_extreme_band", f"WITH {FORECAST_SQL}{scaled_sql()}{widened_sql()} SELECT {_six_sql('q10', 'q50', 'q90')} FROM widened")
def widen(spark, folder):
    return _six(B.corrected(stored_forecast(spark, folder)), "q10", "q50", "q90")


@query("widen_extreme_by_batch", f"WITH {FORECAST_SQL}{scaled_sql(batch='date')}{widened_sql()} SELECT {_six_sql('q10', 'q50', 'q90')} FROM widened")
def widen_by_day(spark, folder):
    return _six(B.corrected(stored_forecast(spark, folder), ["date"]), "q10", "q50", "q90")


@query("widen_fixed", f"WITH {FORECAST_SQL} SELECT {KEY}, q10 - 0.5 AS q10, q90 + 0.5 AS q90 FROM pred")
def widen_by(spark, folder):
    return B.widen_fixed(raw_forecast(spark, folder)).select("hospital_id", "date", "q10", "q90")


@query("blend_median", f"WITH {FORECAST_SQL} SELECT {KEY}, round({blend()}, 6) AS median, round({blend(0.25)}, 6) AS median_light FROM pred")
def blended(spark, folder):
    f = B.blend_median(raw_forecast(spark, folder), weight=0.25).withColumnRenamed("median", "median_light")
    return _six(B.blend_median(f), "median", "median_light")


@query("order_bands_ensemble", f"WITH {FORECAST_SQL}{scaled_sql()}{widened_sql()}{ENSEMBLE} SELECT {_six_sql('lower', 'median', 'upper')} FROM banded")
def ordered(spark, folder):
    return _six(B.order_bands_ensemble(B.blend_median(B.corrected(stored_forecast(spark, folder)))), "lower", "median", "upper")


@query("order_bands_single", f"WITH {FORECAST_SQL} SELECT {KEY}, least(q10, second - 1e-6) AS lower, greatest(q90, second + 1e-6) AS upper FROM pred")
def ordered_single(spark, folder):
    f = raw_forecast(spark, folder).withColumn("median", F.col("second"))
    return B.order_bands(f).select("hospital_id", "date", "lower", "upper")


@query("order_bands_legacy", f"WITH {FORECAST_SQL} SELECT {KEY}, least(q10, second - 1.0) AS lower, greatest(q90, second + 1.0) AS upper FROM pred")
def ordered_older(spark, folder):
    f = raw_forecast(spark, folder).withColumn("median", F.col("second"))
    return B.order_bands(f, 1.0).select("hospital_id", "date", "lower", "upper")


@query("order_bands_train", f"WITH {FORECAST_SQL} SELECT {KEY}, least(q10 + spike, q90 - 1e-6) AS q10, q90 FROM pred")
def ordered_train(spark, folder):
    f = raw_forecast(spark, folder).withColumn("q10", F.col("q10") + F.col("spike"))
    return B.order_bands_train(f).select("hospital_id", "date", "q10", "q90")


@query("no_second_model_path", f"WITH {FORECAST_SQL}{scaled_sql()}{widened_sql()} SELECT {KEY}, round(q10, 6) AS lower, round(q50, 6) AS median, round(q90, 6) AS upper FROM widened")
def single(spark, folder):
    return _six(B.score_mode(stored_forecast(spark, folder).drop("second"), "ensemble"), "lower", "median", "upper")


_MODES = f"""WITH {FORECAST_SQL}{scaled_sql()}{widened_sql(0.5)}"""


@query("score_modes", f"""{_MODES}
SELECT 'xgb' AS mode, {KEY}, round(least(q10, q50 - 1e-6), 6) AS lower, round(q50, 6) AS median, round(greatest(q90, q50 + 1e-6), 6) AS upper FROM widened
UNION ALL SELECT 'tft', {KEY}, round(least(q10, q50 - 1e-6), 6), round({blend()}, 6), round(greatest(q90, q50 + 1e-6), 6) FROM widened
UNION ALL SELECT * FROM (WITH {FORECAST_SQL}{scaled_sql()}{widened_sql()}{ENSEMBLE} SELECT 'ensemble', {KEY}, round(lower, 6), round(median, 6), round(upper, 6) FROM banded)""")
def modes(spark, folder):
    done = B.score_modes(stored_forecast(spark, folder))
    return done.select("mode", "hospital_id", "date", *[F.round(c, 6).alias(c) for c in ("lower", "median", "upper")])


REQUESTS_SQL = FORECAST_SQL + """,
req AS (SELECT *, hospital_id || '/' || strftime(date, '%Y-%m') AS request, CASE hospital_id % 3 WHEN 0 THEN 'xgb' WHEN 1 THEN 'tft' ELSE 'ensemble' END AS mode,
  CASE WHEN hospital_id % 2 = 0 THEN 0.6 ELSE 0.25 END::DOUBLE AS w FROM pred)"""
_BLEND = "(w * second + (CAST(1.0 AS DOUBLE) - w) * q50)"
_FIXED = _BLEND.replace("w", "CAST(0.6 AS DOUBLE)")
_SINGLE = f"""SELECT mode, {KEY}, round(least(q10, q50 - 1e-6), 6) AS lower, round(CASE mode WHEN 'tft' THEN {_FIXED} ELSE q50 END, 6) AS median, round(greatest(q90, q50 + 1e-6), 6) AS upper FROM widened WHERE mode <> 'ensemble'"""
_BOTH = f"""SELECT mode, {KEY}, round(lower, 6) AS lower, round(median, 6) AS median, round(upper, 6) AS upper FROM banded WHERE mode = 'ensemble'"""


@query("score_requests", f"""WITH {REQUESTS_SQL}{scaled_sql('req', 'request')}{widened_sql(0.5)} {_SINGLE}
UNION ALL SELECT * FROM (WITH {REQUESTS_SQL}{scaled_sql('req', 'request')}{widened_sql()}{ENSEMBLE.replace(blend(), _BLEND)} {_BOTH})""")
def requests(spark, folder):
    """Each hospital and month is a request with its own mode and weight."""
    from wardcast.plans.requests import score_requests

    h = F.col("hospital_id")
    raw = stored_forecast(spark, folder).withColumns({
        "request": F.concat_ws("/", h.cast("string"), F.date_format("date", "yyyy-MM")),
        "mode": F.when(h % 3 == 0, F.lit("xgb")).when(h % 3 == 1, F.lit("tft")).otherwise(F.lit("ensemble")),
        "weight_tft": F.when(h % 2 == 0, F.lit(0.6)).otherwise(F.lit(0.25)),
    })
    done = score_requests(raw, ["request"])
    return done.select("mode", "hospital_id", "date", *[F.round(c, 6).alias(c) for c in ("lower", "median", "upper")])


@query("evaluate_forecast", f"""WITH {FORECAST_SQL}, t AS (SELECT quantile_cont(y, 0.75) AS p75 FROM pred), s AS (SELECT * FROM pred, t WHERE y > p75)
SELECT count(*) AS n_rows, round(avg(abs(y - second)), 6) AS mae, round(sqrt(avg((y - second) * (y - second))), 6) AS rmse, round(1 - avg((y - second) * (y - second)) / var_pop(y), 6) AS r2,
  round((1 - avg(abs(y - second)) / avg(y)) * 100, 6) AS accuracy, round(avg(CASE WHEN y BETWEEN q10 AND q90 THEN 1.0 ELSE 0.0 END) * 100, 2) AS coverage_pct,
  (SELECT count(*) FROM s) AS n_spikes, (SELECT round(avg(abs(y - second)), 6) FROM s) AS spike_mae, (SELECT round(sqrt(avg((y - second) * (y - second))), 6) FROM s) AS spike_rmse,
  (SELECT round(avg(CASE WHEN second < y THEN 1.0 ELSE 0.0 END) * 100, 6) FROM s) AS underprediction_pct, (SELECT round(p75, 6) FROM t) AS threshold FROM pred""")
def evaluate(spark, folder):
    done = M.evaluate_forecast(stored_forecast(spark, folder), "y", "second", "q10", "q90")
    six = ("mae", "rmse", "r2", "accuracy", "spike_mae", "spike_rmse", "underprediction_pct", "threshold")
    return done.withColumns({c: F.round(c, 6) for c in six})


# ---- evaluation -------------------------------------------------------------------------

PRED = "pred"
Y, P = "y", "second"


def _metric_sql(by=""):
    keys, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    return f"""SELECT {keys}count(*) AS n_rows, round(avg(abs(y - second)), 4) AS mae, round(sqrt(avg((y - second) * (y - second))), 4) AS rmse,
  round(1 - avg((y - second) * (y - second)) / var_pop(y), 4) AS r2,
  round(greatest(0, (1 - CASE WHEN avg(y) > 0 THEN avg(abs(y - second)) / avg(y) ELSE avg(abs(y - second)) END) * 100), 2) AS accuracy FROM pred {group}"""


@query("regression_metrics", f"WITH {FORECAST_SQL} {_metric_sql()}")
def quality(spark, folder):
    return M.regression_metrics(raw_forecast(spark, folder), Y, P)


@query("regression_metrics_by_city", f"WITH {FORECAST_SQL} {_metric_sql('city')}")
def quality_by_city(spark, folder):
    return M.regression_metrics(raw_forecast(spark, folder), Y, P, ["city"])


@query("regression_metrics_raw", f"""WITH {FORECAST_SQL} SELECT count(*) AS n_rows, round(avg(abs(y - second)), 6) AS mae, round(sqrt(avg((y - second) * (y - second))), 6) AS rmse,
  round(1 - avg((y - second) * (y - second)) / var_pop(y), 6) AS r2, round((1 - avg(abs(y - second)) / avg(y)) * 100, 6) AS accuracy FROM pred""")
def quality_raw(spark, folder):
    done = M.regression_metrics(raw_forecast(spark, folder), Y, P, raw=True)
    return done.withColumns({c: F.round(c, 6) for c in ("mae", "rmse", "r2", "accuracy")})


@query("quantile_coverage", f"""WITH {FORECAST_SQL} SELECT city, round(avg(CASE WHEN y BETWEEN q10 AND q90 THEN 1.0 ELSE 0.0 END), 6) AS coverage,
  round(avg(CASE WHEN y BETWEEN q10 AND q90 THEN 1.0 ELSE 0.0 END) * 100, 2) AS coverage_pct FROM pred GROUP BY 1""")
def coverage(spark, folder):
    done = M.quantile_coverage(raw_forecast(spark, folder), "y", "q10", "q90", ["city"])
    return done.withColumn("coverage", F.round("coverage", 6))


@query("quantile_hit_rate", f"WITH {FORECAST_SQL} SELECT " + ", ".join(f"round(avg(CASE WHEN y <= {c} THEN 1.0 ELSE 0.0 END), 6) AS hit_{c}" for c in ("q10", "q50", "q90")) + " FROM pred")
def hits(spark, folder):
    done = M.quantile_hit_rate(raw_forecast(spark, folder))
    return done.select(*[F.round(c, 6).alias(c) for c in done.columns])


@query("pinball_loss", f"WITH {FORECAST_SQL} SELECT " + ", ".join(f"round(avg(greatest((y - {c}) * {q}, (y - {c}) * {q - 1:.1f})), 6) AS pinball_{c}" for c, q in (("q10", 0.1), ("q50", 0.5), ("q90", 0.9))) + " FROM pred")
def pinball(spark, folder):
    done = M.pinball_loss(raw_forecast(spark, folder), {"q10": 0.1, "q50": 0.5, "q90": 0.9})
    return done.select(*[F.round(c, 6).alias(c) for c in done.columns])


@query("spike_metrics", f"""WITH {FORECAST_SQL}, t AS (SELECT quantile_cont(y, 0.75) AS p75 FROM pred)
SELECT count(*) AS n_spikes, round(avg(abs(y - second)), 6) AS spike_mae, round(sqrt(avg((y - second) * (y - second))), 6) AS spike_rmse,
  round(avg(CASE WHEN second < y THEN 1.0 ELSE 0.0 END) * 100, 6) AS underprediction_pct, round(max(p75), 6) AS threshold FROM pred, t WHERE y > p75""")
def spike_quality(spark, folder):
    done = M.spike_metrics(stored_forecast(spark, folder), Y, P)
    return done.select("n_spikes", *[F.round(c, 6).alias(c) for c in ("spike_mae", "spike_rmse", "underprediction_pct", "threshold")])


FOLDS_SQL = """,
numbered AS (SELECT *, row_number() OVER (ORDER BY date, md5(CAST(hospital_id AS VARCHAR)), hospital_id) AS r, count(*) OVER () AS n FROM pred),
folds AS (SELECT *, CASE WHEN r <= n - (4 - fold) * (n // 4) THEN 'train' WHEN r <= n - (3 - fold) * (n // 4) THEN 'validation' END AS part
  FROM numbered, (SELECT unnest([1, 2, 3]) AS fold))"""


@query("mae_cv", f"""WITH {FORECAST_SQL}{FOLDS_SQL}, m AS (SELECT fold, avg(abs(y - second)) AS mae FROM folds WHERE part = 'validation' GROUP BY 1)
SELECT count(*) AS n_scores, round(avg(mae), 6) AS mean_score, round(stddev_pop(mae), 6) AS std_score FROM m""")
def fold_errors(spark, folder):
    folds = expanding_folds(stored_forecast(spark, folder)).where("part = 'validation'")
    scores = M.regression_metrics(folds, Y, P, ["fold"], raw=True)
    return M.mean_std(scores, "mae").withColumns({c: F.round(c, 6) for c in ("mean_score", "std_score")})
