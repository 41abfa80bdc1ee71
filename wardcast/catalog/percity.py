"""Fits of every city over all features: solutions, quality, time folds, rising effects and quantiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardcast.catalog.features import TRAIN
from wardcast.catalog.registry import query
from wardcast.fixed_values import FEATURES, RISING_FEATURES
from wardcast.functions.scalars import flag
from wardcast.operators import percity
from wardcast.operators.features import feature_matrix
from wardcast.operators.metrics import regression_metrics
from wardcast.plans.tables import LAGGED_SQL, lagged_panel
from wardcast.session import via_table

N = len(FEATURES) + 1
_cells = ", ".join(f"coalesce(CAST(CAST(CAST({TRAIN.get(c, c)} AS DOUBLE) AS FLOAT) AS DOUBLE), 0) AS {c}" for c in FEATURES)
#: The features of each row, and the target y.
MATRIX_SQL = f"{LAGGED_SQL},\nf AS (SELECT city, hospital_id, date, CAST(admissions AS DOUBLE) AS y, {_cells} FROM lagged)"
_columns = [*FEATURES, "y"]
#: The standardised row v: 1, features, target.
_VECTOR = f"""
s AS (SELECT {', '.join(f'avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS s_{c}' for c in _columns)} FROM f),
v AS (SELECT f.city, f.hospital_id, f.date, y, s_y, m_y, [CAST(1 AS DOUBLE), {', '.join(f'({c} - m_{c}) / s_{c}' for c in _columns)}] AS v FROM f, s)"""


def solved_sql(rows: str, by: str) -> str:
    """``fit``: per group the solution b of its normal equations, by elimination; combinations of earlier columns get 0. ``rows`` has the group and v."""
    return f"""
idx AS (SELECT unnest(range(1, {N + 2})) AS i),
prod AS (SELECT {by}, a.i AS i, b.i AS j, sum(v[a.i] * v[b.i]) AS x FROM {rows}, idx AS a, idx AS b GROUP BY ALL),
line AS (SELECT {by}, i, list(x ORDER BY j) AS x FROM prod GROUP BY ALL),
gram AS (SELECT {by}, list(x ORDER BY i) AS m FROM line GROUP BY ALL),
step AS (SELECT {by}, 0 AS k, m, m AS first, [false] AS used FROM gram UNION ALL
  SELECT {by}, k + 1, CASE WHEN m[k + 1][k + 1] > 1e-9 * first[k + 1][k + 1] THEN list_transform(m, (r, i) -> CASE WHEN i = k + 1 THEN list_transform(r, lambda x: x / m[k + 1][k + 1])
    ELSE list_transform(r, lambda x, j: x - r[k + 1] / m[k + 1][k + 1] * m[k + 1][j]) END) ELSE m END, first, list_append(used, m[k + 1][k + 1] > 1e-9 * first[k + 1][k + 1])
  FROM step WHERE k < {N}),
fit AS (SELECT {by}, list_transform(range(1, {N + 1}), lambda i: CASE WHEN used[i + 1] THEN m[i][{N + 1}] ELSE 0 END) AS b FROM step WHERE k = {N})""".replace("(r, i) ->", "lambda r, i:")


PREDICTED = f"s_y * list_dot_product(b, v[1:{N}]) + m_y"


def _matrix(spark, folder):
    """Features and target of every row, written once."""
    return via_table(feature_matrix(lagged_panel(spark, folder), "train", keep=["city", "admissions"]), "matrix")


def _moments(scored, value):
    """Per city and feature: covariance of a column with the feature, in deviations of the feature."""
    own = {c: F.col(c).cast("double") for c in FEATURES}
    cells = [F.struct(F.lit(c).alias("feature"), F.when(F.min(x) < F.max(x), F.covar_pop(F.col(value), x) / F.stddev_pop(x)).otherwise(0.0).alias("moment")) for c, x in own.items()]
    return scored.groupBy("city").agg(F.count("*").alias("n_rows"), F.array(*cells).alias("m")).select("city", "n_rows", F.inline("m"))


_moment_sql = ", ".join(f"round(CASE WHEN stddev_pop({c}) > 0 THEN covar_pop(y, {c}) / stddev_pop({c}) ELSE 0 END, 6) + 0 AS {c}" for c in FEATURES)
MOMENT_SQL = f"m AS (SELECT city, count(*) AS n_rows, {_moment_sql} FROM f GROUP BY 1), u AS (UNPIVOT m ON COLUMNS(* EXCLUDE (city, n_rows)) INTO NAME feature VALUE moment)"


@query("fit_per_entity", f"WITH {MATRIX_SQL}, {MOMENT_SQL} SELECT city, 'ok' AS status, n_rows, feature, moment FROM u")
def fitted(spark, folder):
    """Normal equations of the least squares fits on all features: predictions have the covariances that the target has, which SQL takes from the target."""
    data = _matrix(spark, folder)
    fits = percity.least_squares(data, FEATURES, "admissions")
    found = _moments(percity.predict(data, fits, FEATURES), "median")
    return fits.select("city", "status").join(found, "city").select("city", "status", "n_rows", "feature", (F.round("moment", 6) + F.lit(0.0)).alias("moment"))


@query("per_entity_summary", f"""WITH RECURSIVE {MATRIX_SQL}, {_VECTOR}, {solved_sql('v', 'city')},
p AS (SELECT v.city, y, {PREDICTED} AS p FROM v JOIN fit USING (city))
SELECT city, 'ok' AS status, count(*) AS n_rows, {N - 1}::BIGINT AS n_features, round(avg(abs(y - p)), 6) AS mae, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse, round(1 - avg((y - p) * (y - p)) / var_pop(y), 6) AS r2 FROM p GROUP BY 1""")
def summary(spark, folder):
    """Quality of each city's fit on all features; a city that cannot be fitted would keep a row with its error."""
    data = _matrix(spark, folder)
    fits = percity.least_squares(data, FEATURES, "admissions")
    quality = regression_metrics(percity.predict(data, fits, FEATURES), "admissions", by=["city"], raw=True)
    return fits.select("city", "status", F.size("coefficients").alias("n_features")).join(quality, "city", "left").select(
        "city", "status", "n_rows", "n_features", *(F.round(c, 6).alias(c) for c in ("mae", "rmse", "r2")))


FOLDS = 3


@query("cv_per_entity", f"""WITH RECURSIVE {MATRIX_SQL}, {_VECTOR},
o AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY date, md5(CAST(hospital_id AS VARCHAR)), hospital_id) AS pos, count(*) OVER (PARTITION BY city) AS n FROM v),
fold AS (SELECT o.*, k AS fold, n - ({FOLDS} - k + 1) * (n // {FOLDS + 1}) AS upto FROM o, (SELECT unnest(range(1, {FOLDS + 1})) AS k)),
tr AS (SELECT city, fold, v FROM fold WHERE pos <= upto), {solved_sql('tr', 'city, fold')},
size AS (SELECT city, fold, count(*) AS n_train FROM tr GROUP BY ALL),
p AS (SELECT city, fold, y, {PREDICTED} AS p FROM fold JOIN fit USING (city, fold) WHERE pos > upto AND pos <= upto + n // {FOLDS + 1})
SELECT city, fold, n_train, count(*) AS n_validation, CASE WHEN n_train >= {N} THEN 'ok' ELSE 'error' END AS status, CASE WHEN n_train >= {N} THEN round(avg(abs(y - p)), 5) END AS mae
FROM p JOIN size USING (city, fold) GROUP BY city, fold, n_train""")
def folds(spark, folder):
    """Error of each city's fit in expanding time folds, from sums taken once per part."""
    found = percity.cross_validate(_matrix(spark, folder), FEATURES, "admissions", folds=FOLDS)
    return found.select("city", "fold", "n_train", "n_validation", "status", F.round("mae", 5).alias("mae"))


@query("fit_monotone", f"""WITH {MATRIX_SQL}, {MOMENT_SQL}
SELECT city, n_rows, feature, r.feature IS NOT NULL AS rising, CASE WHEN r.feature IS NULL THEN moment END AS moment, 0::BIGINT AS violated
FROM u LEFT JOIN (SELECT unnest([{', '.join(f"'{c}'" for c in RISING_FEATURES)}]) AS feature) AS r USING (feature)""".replace("r.feature IS NOT NULL AS rising", "CASE WHEN r.feature IS NOT NULL THEN 1 ELSE 0 END::BIGINT AS rising"))
def rising(spark, folder):
    """Least squares whose rising features never lower the prediction. Optimality: the residual has no covariance with free features, nor with rising ones of positive effect; with the
    other rising ones it has none above 0. The moments of free features are those of the target."""
    data = _matrix(spark, folder)
    fits = percity.least_squares(data, FEATURES, "admissions", rising=RISING_FEATURES)
    scored = percity.predict(data, fits, FEATURES).withColumn("left", F.col("admissions") - F.col("median"))
    gaps = _moments(scored, "left").select("city", "feature", F.col("moment").alias("gap"))
    effects = fits.select("city", F.explode(F.arrays_zip(F.array(*map(F.lit, FEATURES)).alias("feature"), F.col("coefficients").alias("effect"))).alias("x")).select("city", "x.*")
    both = _moments(scored, "median").join(gaps, ["city", "feature"]).join(effects, ["city", "feature"])
    may_rise = F.col("feature").isin(RISING_FEATURES)
    off = F.when(may_rise & (F.col("effect") == 0), F.col("gap") > 1e-6).when(may_rise & (F.col("effect") < 0), F.lit(True)).otherwise(F.abs("gap") > 1e-6)
    return both.select("city", "n_rows", "feature", flag(may_rise).alias("rising"), F.when(~may_rise, F.round("moment", 6) + F.lit(0.0)).alias("moment"), flag(off).alias("violated"))


@query("per_city_quantiles", f"""WITH {MATRIX_SQL}, q AS (SELECT unnest([0.1, 0.5, 0.9])::DOUBLE AS level),
c AS (SELECT city, level, quantile_cont(y, 0.1) AS q10, quantile_cont(y, 0.5) AS q50, quantile_cont(y, 0.9) AS q90 FROM f, q GROUP BY ALL),
w AS (SELECT city, level, CASE level WHEN 0.1 THEN q10 WHEN 0.5 THEN q50 ELSE q90 END AS v FROM c)
SELECT city, level, 'ok' AS status, count(*) AS n_rows, {N - 1}::BIGINT AS n_features, round(avg(greatest(level * (y - v), (level - 1) * (y - v))), 6) AS constant_loss,
  0::BIGINT AS violated, 1::BIGINT AS share_fits, 1::BIGINT AS better FROM w JOIN f USING (city) GROUP BY city, level""")
def quantile_bands(spark, folder):
    """Quantile regressions of each city on all features.

    From the predictions of the rows: ``violated`` counts used features (in deviations from their mean) whose subgradient condition fails, ``share_fits`` says whether the rows below the fit are
    as many as the level asks for, up to those on the fit, and ``better`` whether the loss is below that of the city's best constant, which SQL computes.
    """
    data = _matrix(spark, folder)
    fits = via_table(percity.quantile_fits(data, FEATURES, "admissions"), "quantile-fits")
    mean, std = percity.scales(data, FEATURES)
    scaled = [(F.col(c).cast("double") - float(m)) / float(s) for c, m, s in zip(FEATURES, mean, std)]
    out = None
    for level in (0.1, 0.5, 0.9):
        own = fits.where(F.col("level") == level)
        scored = percity.predict(data, own, FEATURES, prediction="q")
        constant = data.groupBy("city").agg(F.percentile("admissions", F.lit(level)).alias("v"), F.stddev_pop("admissions").alias("spread"))
        rows = scored.join(constant, "city").join(own.select("city", "coefficients"), "city").withColumn("r", F.col("admissions") - F.col("q"))
        near = F.abs("r") <= 1.01 * percity.ON_FIT * F.col("spread")
        pull = F.when(near, 0.0).when(F.col("r") < 0, level - 1).otherwise(level)
        off = [(F.max(F.abs(F.col("coefficients")[i])) > 0) & (F.abs(F.sum(pull * x)) > F.sum(F.when(near, F.abs(x) * max(level, 1 - level)).otherwise(0.0)) + 1e-6 * F.count("*")) for i, x in enumerate(scaled)]
        loss = lambda v: F.avg(F.greatest(level * (F.col("admissions") - v), (level - 1) * (F.col("admissions") - v)))
        below, on = F.count_if((F.col("r") < 0) & ~near), F.count_if(near)
        part = rows.groupBy("city").agg(
            F.count("*").alias("n_rows"), F.round(loss(F.col("v")), 6).alias("constant_loss"), sum((flag(x) for x in off), F.lit(0)).alias("violated"),
            flag((below <= level * F.count("*")) & (below + on >= level * F.count("*"))).alias("share_fits"), flag(loss(F.col("q")) < loss(F.col("v"))).alias("better"))
        part = own.select("city", "level", "status", F.size("coefficients").alias("n_features")).join(part, "city", "left")
        out = part if out is None else out.unionByName(part)
    return out.select("city", "level", "status", "n_rows", "n_features", "constant_loss", "violated", "share_fits", "better")
