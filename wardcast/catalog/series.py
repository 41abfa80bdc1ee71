"""Windows over entities, dense calendars and panel utilities."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardcast.catalog.registry import query
from wardcast.functions.calendar import periodic_mark, wave, weekday_of, yearly_wave
from wardcast.operators import panel as P
from wardcast.operators import windows as S
from wardcast.operators.ordering import running_positions
from wardcast.plans.tables import PANEL_SQL, panel, stored_panel
from wardcast.sources.readers import table

KEY = "hospital_id::BIGINT AS hospital_id, CAST(date AS VARCHAR) AS date"
W = "WINDOW w AS (PARTITION BY hospital_id ORDER BY date)"


@query("lag_features", f"""WITH {PANEL_SQL}
SELECT {KEY}, admissions, coalesce(lag(admissions, 1) OVER w, first_value(admissions) OVER w) AS lag_1_admissions,
  coalesce(lag(admissions, 7) OVER w, first_value(admissions) OVER w) AS lag_7_admissions FROM panel {W}""")
def lags(spark, folder):
    return S.lag_features(panel(spark, folder)).select("hospital_id", "date", "admissions", "lag_1_admissions", "lag_7_admissions")


@query("rolling_mean_14", f"""WITH {PANEL_SQL}
SELECT {KEY}, round(avg(admissions) OVER (w ROWS BETWEEN 13 PRECEDING AND CURRENT ROW), 2) AS rolling_14_admissions FROM panel {W}""")
def rolling(spark, folder):
    return S.lag_features(panel(spark, folder)).select("hospital_id", "date", "rolling_14_admissions")


@query("rolling_mean_14_strict", f"""WITH {PANEL_SQL}
SELECT {KEY}, round(coalesce(avg(admissions) OVER (w ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING), -1), 6) AS rolling_14_strict FROM panel {W}""")
def rolling_strict(spark, folder):
    mean = S.rolling_mean(F.col("admissions"), 14, S.series(), strict=True)
    return panel(spark, folder).select("hospital_id", "date", F.round(F.coalesce(mean, F.lit(-1.0)), 6).alias("rolling_14_strict"))


@query("lag_features_unpartitioned", f"""WITH {PANEL_SQL}
SELECT {KEY}, CAST(coalesce(lag(admissions, 1) OVER w, first_value(admissions) OVER w) AS DOUBLE) AS lag_1_admissions,
  CAST(coalesce(lag(admissions, 7) OVER w, first_value(admissions) OVER w) AS DOUBLE) AS lag_7_admissions,
  round(avg(admissions) OVER (w ROWS BETWEEN 13 PRECEDING AND CURRENT ROW), 6) AS rolling_14_admissions,
  CAST(150 AS DOUBLE) AS level_without_target FROM panel {W}""")
def serving(spark, folder):
    p = panel(spark, folder).select("hospital_id", "date", "admissions")
    bare = S.serving_lags(p.select("hospital_id", "date")).select("hospital_id", "date", F.col("lag_7_admissions").alias("level_without_target"))
    done = S.serving_lags(p).drop("admissions").withColumn("rolling_14_admissions", F.round("rolling_14_admissions", 6))
    return done.join(bare, ["hospital_id", "date"])


@query("lag_exogenous", f"""WITH {PANEL_SQL}
SELECT {KEY}, coalesce(lag(aqi, 1) OVER w, first_value(aqi) OVER w) AS lag1_aqi,
  coalesce(lag(outbreak_index, 7) OVER w, first_value(outbreak_index) OVER w) AS lag7_outbreak,
  round(avg(aqi) OVER (w ROWS BETWEEN 13 PRECEDING AND CURRENT ROW), 6) AS rolling_aqi FROM panel {W}""")
def exogenous(spark, folder):
    done = S.lag_exogenous(panel(spark, folder)).withColumn("rolling_aqi", F.round("rolling_aqi", 6))
    return done.select("hospital_id", "date", "lag1_aqi", "lag7_outbreak", "rolling_aqi")


@query("exogenous_identity", f"WITH {PANEL_SQL} SELECT {KEY}, aqi AS lag1_aqi, outbreak_index AS lag7_outbreak, aqi AS rolling_aqi FROM panel")
def identity(spark, folder):
    return S.exogenous_identity(panel(spark, folder)).select("hospital_id", "date", "lag1_aqi", "lag7_outbreak", "rolling_aqi")


_LEADS = [(c, h) for h in range(1, 8) for c in ("aqi", "temp", "rainfall")]


@query("lead_covariates", f"""WITH {PANEL_SQL}
SELECT {KEY}, {', '.join(f"coalesce(f{h}.{c}, -9999) AS {c}_forecast_{h}" for c, h in _LEADS)}
FROM (SELECT * FROM panel) p {' '.join(f"LEFT JOIN (SELECT hospital_id AS h{h}, date AS d{h}, aqi, temp, rainfall FROM panel) f{h} ON f{h}.h{h} = p.hospital_id AND f{h}.d{h} = p.date + {h}" for h in range(1, 8))}""")
def leads(spark, folder):
    wide = S.lead_covariates(panel(spark, folder))
    return wide.select("hospital_id", "date", *[F.coalesce(f"{c}_forecast_{h}", F.lit(-9999.0)).alias(f"{c}_forecast_{h}") for c, h in _LEADS])


@query("time_index", f"WITH {PANEL_SQL} SELECT {KEY}, CAST(date - (SELECT min(date) FROM panel) AS BIGINT) AS time_idx FROM panel")
def index(spark, folder):
    return S.time_index(stored_panel(spark, folder)).select("hospital_id", "date", "time_idx")


@query("running_number", f"""WITH {PANEL_SQL}
SELECT {KEY}, city, row_number() OVER (PARTITION BY city ORDER BY date, md5(CAST(hospital_id AS VARCHAR)), hospital_id) - 1 AS number FROM panel""")
def running(spark, folder):
    return running_positions(stored_panel(spark, folder), ["city"], name="number").select("hospital_id", "date", "city", "number")


@query("rank_positions", f"""WITH {PANEL_SQL}
SELECT {KEY}, row_number() OVER (ORDER BY date, md5(CAST(hospital_id AS VARCHAR)), hospital_id) - 1 AS position FROM panel""")
def positions(spark, folder):
    return running_positions(stored_panel(spark, folder)).select("hospital_id", "date", "position")


@query("dense_calendar", f"""WITH {PANEL_SQL},
grid AS (SELECT h.hospital_id, CAST(d.d AS DATE) AS date FROM (SELECT DISTINCT hospital_id FROM panel) h,
  (SELECT unnest(generate_series((SELECT min(date) FROM panel), (SELECT max(date) FROM panel), INTERVAL 1 DAY)) AS d) d)
SELECT g.hospital_id::BIGINT AS hospital_id, CAST(g.date AS VARCHAR) AS date, coalesce(admissions, 0) AS admissions, coalesce(aqi, -1) AS aqi
FROM grid g LEFT JOIN panel p ON p.hospital_id = g.hospital_id AND p.date = g.date""")
def dense(spark, folder):
    grid = P.dense_calendar(stored_panel(spark, folder).select("hospital_id", "date", "admissions", "aqi"))
    return grid.select("hospital_id", "date", F.coalesce("admissions", F.lit(0).cast("bigint")).alias("admissions"), F.coalesce("aqi", F.lit(-1.0)).alias("aqi"))


@query("daily_rollup", """
SELECT l_suppkey, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS date, count(*) AS n_lines, CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS BIGINT) AS quantity,
  max(l_extendedprice) AS top_price FROM lineitem GROUP BY 1, 2""")
def rollup(spark, folder):
    return P.daily_rollup(table(spark, folder, "lineitem"), ["l_suppkey"], "l_shipdate", {
        "n_lines": F.count("*"), "quantity": F.sum(F.round("l_quantity").cast("bigint")), "top_price": F.max("l_extendedprice")})


FEASTS = "feasts AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) + 14 AS day FROM orders)"
CLOSED = "closed AS (SELECT DISTINCT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS day FROM orders)"


def feasts(spark, folder):
    """Event days that the orders give: the 15th of every month with an order."""
    return table(spark, folder, "orders").select(F.date_add(F.trunc("o_orderdate", "month"), 14).alias("day")).distinct()


def closed_days(spark, folder):
    return table(spark, folder, "orders").select(F.trunc("o_orderdate", "quarter").alias("day")).distinct()


@query("event_window_join", f"""WITH {PANEL_SQL}, {FEASTS}
SELECT {KEY}, CASE WHEN n > 0 THEN 1 ELSE 0 END::BIGINT AS near_flag, n * CAST(80 AS DOUBLE) AS event_effect
FROM (SELECT p.hospital_id, p.date, count(f.day) AS n FROM panel p LEFT JOIN feasts f ON abs(p.date - f.day) <= 1 GROUP BY 1, 2)""")
def events_near(spark, folder):
    return P.event_window_join(panel(spark, folder), feasts(spark, folder), 80.0).select("hospital_id", "date", "near_flag", "event_effect")


@query("holiday_semi_join", f"""WITH {PANEL_SQL}, {CLOSED}
SELECT CASE WHEN date IN (SELECT day FROM closed) THEN 'on' ELSE 'off' END AS side, {KEY} FROM panel""")
def holidays(spark, folder):
    p, days = panel(spark, folder).select("hospital_id", "date"), closed_days(spark, folder).withColumnRenamed("day", "date")
    on = P.on_listed_days(p, days).withColumn("side", F.lit("on"))
    return on.unionByName(P.on_listed_days(p, days, keep=False).withColumn("side", F.lit("off")))


@query("calendar_flags", f"""WITH {PANEL_SQL}, {FEASTS}, {CLOSED}
SELECT {KEY}, CAST(isodow(date) - 1 AS BIGINT) AS weekday, CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END::BIGINT AS is_weekend,
  CASE WHEN EXISTS (SELECT 1 FROM feasts WHERE abs(panel.date - day) <= 1) THEN 1 ELSE 0 END::BIGINT AS festival_flag,
  CASE WHEN date IN (SELECT day FROM closed) THEN 1 ELSE 0 END::BIGINT AS holiday_flag FROM panel""")
def flags(spark, folder):
    done = P.calendar_flags(panel(spark, folder), feasts(spark, folder), closed_days(spark, folder))
    return done.select("hospital_id", "date", "weekday", "is_weekend", "festival_flag", "holiday_flag")


@query("seasonal_terms", f"""WITH {PANEL_SQL}
SELECT {KEY}, round(60 * sin(2 * pi() * dayofyear(date) / 365.0), 9) AS season, round(8 * sin(2 * pi() * dayofyear(date) / 365.0 + 0.2), 9) AS season_shifted,
  round(cos(2 * pi() * (CAST(isodow(date) - 1 AS DOUBLE)) / 7.0), 9) AS week_cos FROM panel""")
def seasons(spark, folder):
    day = F.col("date")
    return panel(spark, folder).select(
        "hospital_id", "date", F.round(yearly_wave(day, 60.0), 9).alias("season"), F.round(yearly_wave(day, 8.0, 0.2), 9).alias("season_shifted"),
        F.round(wave(weekday_of(day).cast("double"), 7.0, "cos"), 9).alias("week_cos"))


@query("periodic_marker", f"""WITH {PANEL_SQL}
SELECT {KEY}, CAST(CASE WHEN (date - DATE '0001-01-01' + 1) % 111 = 0 THEN 1.0 WHEN (date - DATE '0001-01-01' + 1) % 37 = 0 THEN 0.4 ELSE 0 END AS DOUBLE) AS mark FROM panel""")
def marks(spark, folder):
    return panel(spark, folder).select("hospital_id", "date", periodic_mark(F.col("date")).alias("mark"))


_TERMS = ["weekday_term", "season_term", "cold_term", "heat_term", "drift_term", "aqi_excess", "heavy_rain", "mobility_term", "outbreak_factor", "holiday_factor", "baseline", "explained"]


@query("effect_decomposition", f"""WITH {PANEL_SQL},
t AS (SELECT hospital_id, date, CAST(80 + population_density / 200 + 10 * hospital_id_enc AS DOUBLE) AS base,
  CASE WHEN weekday IN (0, 1) THEN 10.0 WHEN weekday IN (5, 6) THEN -12.0 ELSE 0.0 END AS weekday_term, 8 * sin(2 * pi() * dayofyear(date) / 365 + 0.2) AS season_term,
  0.6 * greatest(0, 25 - temp) AS cold_term, 0.4 * greatest(0, temp - 34) AS heat_term, 0.02 * (city_id + 1) * hospital_id_enc AS drift_term,
  greatest(0, aqi - 150) AS aqi_excess, greatest(0, rainfall - 30) AS heavy_rain, -0.025 * greatest(0, 100 - mobility_index) AS mobility_term,
  1 + outbreak_index * 0.6 AS outbreak_factor, CASE WHEN holiday_flag = 1 THEN 0.88 ELSE 1 END AS holiday_factor FROM panel),
u AS (SELECT *, base + weekday_term + season_term + cold_term + heat_term + drift_term AS baseline FROM t),
v AS (SELECT *, (baseline + mobility_term) * outbreak_factor * holiday_factor AS explained FROM u)
SELECT {KEY}, {', '.join(f'round(CAST({c} AS DOUBLE), 6) AS {c}' for c in _TERMS)} FROM v""")
def effects(spark, folder):
    base = F.lit(80.0) + F.col("population_density") / F.lit(200.0) + F.lit(10.0) * F.col("hospital_id_enc")
    done = P.effect_decomposition(panel(spark, folder), base, F.col("city_id"), F.col("hospital_id_enc"))
    return done.select("hospital_id", "date", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in _TERMS])


