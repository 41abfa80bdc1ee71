"""Feature projections of both profiles, matrices, scaling and reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardcast.catalog.registry import query
from wardcast.fixed_values import FEATURES, RISING_FEATURES, UNSCALED_FEATURES
from wardcast.functions.features import air_columns, calendar_columns, interaction_columns, lag_interactions
from wardcast.operators.features import feature_matrix, feature_skew, features, monotone_report, scale_features
from wardcast.session import via_table
from wardcast.plans.tables import LAGGED_SQL, PANEL_SQL, lagged_panel, panel

KEY = "hospital_id::BIGINT AS hospital_id, CAST(date AS VARCHAR) AS date"
TAU = "(2 * pi())"


def _d(x: float) -> str:
    return f"CAST({x} AS DOUBLE)"


# SQL of every engineered column, per profile
TRAIN = {
    "month": "month(date)", "week_of_year": "weekofyear(date)", "quarter": "quarter(date)",
    "season": "(month(date) % 12) // 3 + 1",
    "day_sin": f"sin({TAU} * dayofyear(date) / {_d(365.25)})", "day_cos": f"cos({TAU} * dayofyear(date) / {_d(365.25)})",
    "month_sin": f"sin({TAU} * month(date) / {_d(12)})", "month_cos": f"cos({TAU} * month(date) / {_d(12)})",
    "aqi_above_150": "CASE WHEN aqi > 150 THEN 1 ELSE 0 END", "aqi_above_200": "CASE WHEN aqi > 200 THEN 1 ELSE 0 END",
    "aqi_above_300": "CASE WHEN aqi > 300 THEN 1 ELSE 0 END",
    "aqi_severity": "CASE WHEN aqi < 0 THEN NULL WHEN aqi <= 50 THEN 0 WHEN aqi <= 100 THEN 1 WHEN aqi <= 150 THEN 2 WHEN aqi <= 200 THEN 3 WHEN aqi <= 300 THEN 4 WHEN aqi <= 1000 THEN 5 END",
    "temp_humidity": "temp * humidity",
    "rainfall_injury_risk": f"rainfall * CASE WHEN rainfall > 20 THEN {_d(1.5)} ELSE {_d(1.0)} END",
    "aqi_respiratory_ratio": f"aqi * CASE WHEN aqi > 100 THEN {_d(1.3)} ELSE {_d(1.0)} END",
    "aqi_temp": "aqi * temp", "mobility_outbreak": "mobility_index * (1 + outbreak_index)", "temp_rainfall": "temp * rainfall",
    "rainfall_weekend": "rainfall * is_weekend", "aqi_mobility": "aqi * (100 - mobility_index) / 100",
    "lag1_aqi": "lag_1_admissions * (aqi / 100)", "lag7_outbreak": "lag_7_admissions * (1 + outbreak_index)",
    "rolling_aqi": "rolling_14_admissions * (aqi / 100)",
}
SERVE = TRAIN | {
    "season": "(month(date) % 12) // 3",
    "day_sin": f"sin({TAU} * dayofyear(date) / {_d(365)})", "day_cos": f"cos({TAU} * dayofyear(date) / {_d(365)})",
    "aqi_severity": f"{_d(0.5)} * (aqi > 150)::INT + {_d(1.0)} * (aqi > 200)::INT + {_d(1.5)} * (aqi > 300)::INT",
    "rainfall_injury_risk": "rainfall * is_weekend", "aqi_respiratory_ratio": f"aqi / ({_d(0)} + 1)",
    "aqi_mobility": "aqi * mobility_index", "lag7_outbreak": "lag_7_admissions * (1 + outbreak_index / 100)",
}
SERVE.pop("rainfall_weekend")
WHOLE = {"month", "week_of_year", "quarter", "season", "aqi_above_150", "aqi_above_200", "aqi_above_300"}
WAVES = {"day_sin", "day_cos", "month_sin", "month_cos"}


def _columns(profile: str) -> dict[str, Column]:
    day = F.col("date")
    return calendar_columns(day, profile) | air_columns(F.col("aqi"), profile) | interaction_columns(profile) | lag_interactions(profile)


def _kind(profile: str, column: str) -> str:
    return "BIGINT" if column in WHOLE or (column == "aqi_severity" and profile == "train") else "DOUBLE"


def _pair(name: str, columns: list[str]) -> None:
    """Register one feature family with both profiles side by side."""
    lagged = any("lag" in c or "rolling" in c for c in columns)
    base, source = (LAGGED_SQL, "lagged") if lagged else (PANEL_SQL, "panel")
    shown = [(p, c) for p, formulas in (("train", TRAIN), ("serve", SERVE)) for c in columns if c in formulas]
    sql = []
    for p, c in shown:
        text = (TRAIN if p == "train" else SERVE)[c]
        text = f"round({text}, 9)" if c in WAVES else text
        sql.append(f"CAST({text} AS {_kind(p, c)}) AS {p}_{c}")

    @query(name, f"WITH {base} SELECT {KEY}, {', '.join(sql)} FROM {source}")
    def run(spark, folder):
        df = lagged_panel(spark, folder) if lagged else panel(spark, folder)
        own = {p: _columns(p) for p in ("train", "serve")}
        cells = [(F.round(own[p][c], 9) if c in WAVES else own[p][c]).alias(f"{p}_{c}") for p, c in shown]
        return df.select("hospital_id", "date", *cells)


for _name, _cols in {
    "feat_month": ["month"], "feat_quarter": ["quarter"], "feat_week_iso": ["week_of_year"], "feat_season": ["season"],
    "feat_day_cyclic": ["day_sin", "day_cos"], "feat_month_cyclic": ["month_sin", "month_cos"],
    "feat_aqi_flags": ["aqi_above_150", "aqi_above_200", "aqi_above_300"], "feat_aqi_severity": ["aqi_severity"],
    "feat_temp_humidity": ["temp_humidity"], "feat_rain_injury": ["rainfall_injury_risk"],
    "feat_aqi_respiratory": ["aqi_respiratory_ratio"], "feat_aqi_temp": ["aqi_temp"],
    "feat_mobility_outbreak": ["mobility_outbreak"], "feat_temp_rain": ["temp_rainfall"],
    "feat_rain_weekend": ["rainfall_weekend"], "feat_aqi_mobility": ["aqi_mobility"],
    "feat_lag1_aqi": ["lag1_aqi"], "feat_lag7_outbreak": ["lag7_outbreak"], "feat_rolling_aqi": ["rolling_aqi"],
}.items():
    _pair(_name, _cols)


@query("feat_day_of_year", f"WITH {PANEL_SQL} SELECT {KEY}, CAST(dayofyear(date) AS BIGINT) AS day_of_year FROM panel")
def day_of_year(spark, folder):
    return panel(spark, folder).select("hospital_id", "date", F.dayofyear("date").alias("day_of_year"))


def _matrix_sql(formulas: dict[str, str]) -> str:
    cells = []
    for c in FEATURES:
        text = f"coalesce(CAST(CAST({formulas.get(c, c)} AS DOUBLE) AS FLOAT), 0)"
        cells.append(f"CAST({text} AS DOUBLE) AS {c}" if c not in WAVES else f"round(CAST({text} AS DOUBLE), 6) AS {c}")
    return ", ".join(cells)


def _rounded(df):
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in WAVES})


@query("feature_matrix", f"""WITH {LAGGED_SQL}
SELECT 'train' AS profile, {KEY}, {_matrix_sql(TRAIN)} FROM lagged UNION ALL SELECT 'serve' AS profile, {KEY}, {_matrix_sql(SERVE)} FROM lagged""")
def matrix(spark, folder):
    df = lagged_panel(spark, folder)
    parts = [_rounded(feature_matrix(df, p)).select(F.lit(p).alias("profile"), "*") for p in ("train", "serve")]
    return parts[0].unionByName(parts[1])


_CONTINUOUS = [c for c in FEATURES if c not in UNSCALED_FEATURES]
_FULL = ", ".join(f"CAST({TRAIN.get(c, c)} AS DOUBLE) AS {c}" for c in _CONTINUOUS)


@query("scale_features", f"""WITH {LAGGED_SQL}, f AS (SELECT hospital_id, date, festival_flag, {_FULL} FROM lagged),
m AS (SELECT {', '.join(f'avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS s_{c}' for c in _CONTINUOUS)} FROM f)
SELECT {KEY}, CAST(festival_flag AS BIGINT) AS festival_flag, {', '.join(f'round(({c} - m_{c}) / s_{c}, 6) AS {c}' for c in _CONTINUOUS)} FROM f, m""")
def scaled(spark, folder):
    df = features(via_table(lagged_panel(spark, folder), "panel"))
    done = scale_features(df.select("hospital_id", "date", "festival_flag", *[F.col(c).cast("double").alias(c) for c in _CONTINUOUS]))
    return done.withColumns({c: F.round(c, 6) for c in _CONTINUOUS})


_SKEWED = [c for c in FEATURES if c in TRAIN and c in SERVE]


def _gap(c: str) -> str:
    return f"abs(coalesce(CAST({TRAIN[c]} AS DOUBLE), 0) - coalesce(CAST({SERVE[c]} AS DOUBLE), 0))"


@query("feature_skew", f"WITH {LAGGED_SQL}, g AS (SELECT {', '.join(f'{_gap(c)} AS {c}' for c in _SKEWED)} FROM lagged) " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST(count(*) FILTER (WHERE {c} > 1e-9) AS BIGINT) AS rows_differing, round(max({c}), 6) AS largest_gap FROM g" for c in _SKEWED))
def skew(spark, folder):
    return feature_skew(lagged_panel(spark, folder)).withColumn("largest_gap", F.round("largest_gap", 6))


def _bucket_sql(c: str) -> str:
    return (f"SELECT '{c}' AS feature, aqi AS p, CASE WHEN hi_{c} = lo_{c} THEN 0 ELSE least(floor((CAST({c} AS DOUBLE) - lo_{c}) / (hi_{c} - lo_{c}) * 10.0), 9) END::BIGINT AS bucket FROM f, s")


@query("monotone_report", f"""WITH {LAGGED_SQL},
f AS (SELECT aqi, outbreak_index, {', '.join(f'{TRAIN[c]} AS {c}' for c in RISING_FEATURES if c in TRAIN)} FROM lagged),
s AS (SELECT {', '.join(f'CAST(min({c}) AS DOUBLE) AS lo_{c}, CAST(max({c}) AS DOUBLE) AS hi_{c}' for c in RISING_FEATURES)} FROM f),
b AS ({' UNION ALL '.join(_bucket_sql(c) for c in RISING_FEATURES)}),
a AS (SELECT feature, bucket, count(*) AS n_rows, avg(p) AS mean_prediction, sum(CAST(round(p * 100) AS BIGINT)) AS cents FROM b GROUP BY 1, 2)
SELECT feature, bucket, n_rows, CAST(cents AS BIGINT) AS cents,
  CASE WHEN mean_prediction < lag(mean_prediction) OVER (PARTITION BY feature ORDER BY bucket) THEN 1 ELSE 0 END::BIGINT AS falls FROM a""")
def monotone(spark, folder):
    df = features(via_table(lagged_panel(spark, folder), "panel")).withColumn("q50", F.col("aqi"))
    # The predictions have two decimals: their sum in cents does not depend on the order of addition.
    report = monotone_report(df, "q50")
    return report.select("feature", "bucket", "n_rows", F.round(F.col("mean_prediction") * F.col("n_rows") * 100).cast("bigint").alias("cents"), "falls")
