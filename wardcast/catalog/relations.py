"""Predicates, joins, aggregates, sorts, top rows and unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardcast.catalog.registry import query
from wardcast.functions.fixed import fixed_row
from wardcast.functions.scalars import flag, is_between
from wardcast.operators import metrics, relate
from wardcast.operators.bands import any_adjustment, combine_models
from wardcast.operators.ordering import top_rows
from wardcast.operators.quantiles import quantile_row, quantiles
from wardcast.operators.weights import residuals, spike_threshold
from wardcast.plans.tables import FORECAST_SQL, PANEL_SQL, panel, raw_forecast, stored_forecast
from wardcast.sources.readers import table

KEY = "hospital_id::BIGINT AS hospital_id, CAST(date AS VARCHAR) AS date"
LEVELS = [0.70, 0.75, 0.85, 0.90, 0.95, 0.99]


@query("threshold_flags", f"""WITH {PANEL_SQL}
SELECT {KEY}, CASE WHEN aqi > 150 THEN 1 ELSE 0 END::BIGINT AS bad_air, CASE WHEN rainfall > 20 THEN 1 ELSE 0 END::BIGINT AS wet, CASE WHEN aqi > 100 THEN 1 ELSE 0 END::BIGINT AS poor_air FROM panel""")
def thresholds(spark, folder):
    return panel(spark, folder).select(
        "hospital_id", "date", flag(F.col("aqi") > 150).alias("bad_air"), flag(F.col("rainfall") > 20).alias("wet"), flag(F.col("aqi") > 100).alias("poor_air"))


@query("spike_filter", f"""WITH {FORECAST_SQL}, t AS (SELECT quantile_cont(y, 0.7) AS p70, quantile_cont(y, 0.75) AS p75 FROM pred)
SELECT {KEY}, y, p70 AS threshold, CASE WHEN y > p75 THEN 1 ELSE 0 END::BIGINT AS evaluated_as_spike FROM pred, t WHERE y > p70""")
def spikes(spark, folder):
    f = stored_forecast(spark, folder)
    marked = spike_threshold(f).where("is_spike").drop("is_spike")
    upper = fixed_row(quantile_row(f, {"y": F.col("y")}, [0.75]))["y"]["q"][0]
    return marked.withColumn("p75", upper).select("hospital_id", "date", "y", "threshold", flag(F.col("y") > F.col("p75")).alias("evaluated_as_spike"))


@query("interval_membership", f"WITH {FORECAST_SQL} SELECT {KEY}, CASE WHEN y >= q10 AND y <= q90 THEN 1 ELSE 0 END::DOUBLE AS inside FROM pred")
def membership(spark, folder):
    return raw_forecast(spark, folder).select("hospital_id", "date", is_between(F.col("y"), F.col("q10"), F.col("q90")).alias("inside"))


@query("positive_residuals", f"""WITH {FORECAST_SQL}, r AS (SELECT *, y - q50 AS residual FROM pred)
SELECT CAST(count(*) FILTER (WHERE residual > 0) AS BIGINT) AS n_positive, round(quantile_cont(residual, 0.9) FILTER (WHERE residual > 0), 6) AS p90_positive,
  round(quantile_cont(residual, 0.99) FILTER (WHERE residual > 0), 6) AS p99_positive FROM r""")
def positive(spark, folder):
    r = F.col("residual")
    stats = quantile_row(residuals(stored_forecast(spark, folder)), {"gain": F.when(r > 0, r)}, [0.9, 0.99])
    return stats.select(F.col("gain.n").alias("n_positive"), F.round(F.col("gain.q")[0], 6).alias("p90_positive"), F.round(F.col("gain.q")[1], 6).alias("p99_positive"))


@query("membership_test", f"""WITH {PANEL_SQL}
SELECT {KEY}, CASE WHEN weekday IN (0, 1) THEN 1 ELSE 0 END::BIGINT AS early_week, CASE WHEN month(date) IN (6, 7, 8, 9) THEN 1 ELSE 0 END::BIGINT AS rainy_month FROM panel""")
def in_list(spark, folder):
    return panel(spark, folder).select(
        "hospital_id", "date", flag(F.col("weekday").isin(0, 1)).alias("early_week"), flag(F.month("date").isin(6, 7, 8, 9)).alias("rainy_month"))


@query("dim_lookup_join", """
SELECT o_orderkey, o_custkey, c_mktsegment, coalesce(c_nationkey, -1)::BIGINT AS c_nationkey, coalesce(n_name, 'unknown') AS n_name
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""")
def lookup(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_nationkey")
    nations = table(spark, folder, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    done = relate.dim_lookup_join(relate.dim_lookup_join(orders, customers, ["o_custkey"]), nations, ["c_nationkey"])
    return done.select(
        "o_orderkey", "o_custkey", "c_mktsegment", F.coalesce("c_nationkey", F.lit(-1)).alias("c_nationkey"), F.coalesce("n_name", F.lit("unknown")).alias("n_name"))


@query("predictions_to_actuals", f"WITH {FORECAST_SQL} SELECT {KEY}, q50 AS median, y, round(y - q50, 9) AS error FROM pred")
def actuals(spark, folder):
    f = raw_forecast(spark, folder)
    predicted = f.select("hospital_id", "date", F.col("q50").alias("median"))
    done = relate.predictions_to_actuals(predicted, f.select("hospital_id", "date", "y"))
    return done.withColumn("error", F.round(F.col("y") - F.col("median"), 9))


@query("combine_models", f"WITH {FORECAST_SQL} SELECT {KEY}, q10, q50, q90, spike, extreme, second FROM pred")
def combine(spark, folder):
    f, key = raw_forecast(spark, folder), ["hospital_id", "date"]
    return combine_models(f.select(*key, "q10", "q50", "q90"), f.select(*key, "spike", "extreme"), f.select(*key, "second"))


@query("batch_scalar_join", f"""WITH {FORECAST_SQL}, t AS (SELECT city, count(*) AS n, quantile_cont(q50, 0.9) AS p90 FROM pred GROUP BY 1)
SELECT {KEY}, pred.city, n AS batch_rows, CASE WHEN q50 > p90 THEN 1 ELSE 0 END::BIGINT AS above FROM pred JOIN t ON pred.city = t.city""")
def batch_stats(spark, folder):
    f = stored_forecast(spark, folder)
    stats = quantile_row(f, {"q50": F.col("q50")}, [0.9], ["city"])
    done = relate.batch_scalar_join(f, stats, "batch", ["city"])
    return done.select("hospital_id", "date", "city", F.col("batch.q50.n").alias("batch_rows"), flag(F.col("q50") > F.col("batch.q50.q")[0]).alias("above"))


@query("profile_panel", f"""WITH {PANEL_SQL}
SELECT count(*) AS n_rows, CAST(min(date) AS VARCHAR) AS first_date, CAST(max(date) AS VARCHAR) AS last_date, count(DISTINCT city) AS n_cities, count(DISTINCT hospital_id) AS n_hospitals FROM panel""")
def profile(spark, folder):
    return metrics.profile_panel(panel(spark, folder))


@query("distinct_cities", f"WITH {PANEL_SQL} SELECT city, count(*) AS n_rows FROM panel GROUP BY 1")
def cities(spark, folder):
    return metrics.distinct_values(panel(spark, folder), "city")


@query("batch_quantiles", "SELECT 'all' AS event_type, count(*) AS n, " + ", ".join(f"round(quantile_cont(value, {p}), 6) AS p{int(round(p * 100))}" for p in LEVELS)
       + " FROM events UNION ALL SELECT event_type, count(*), " + ", ".join(f"round(quantile_cont(value, {p}), 6)" for p in LEVELS) + " FROM events GROUP BY 1")
def percentiles(spark, folder):
    events = table(spark, folder, "events")
    cells = [F.round(F.col("q")[i], 6).alias(f"p{int(round(p * 100))}") for i, p in enumerate(LEVELS)]
    found = quantiles(events, {"value": F.col("value")}, LEVELS, ["event_type"], sets=[[], ["event_type"]])
    return found.select(F.when(F.col("set") == 0, F.lit("all")).otherwise(F.col("event_type")).alias("event_type"), "n", *cells)


@query("adjustment_stats", f"""WITH {FORECAST_SQL}, t AS (SELECT quantile_cont(y, 0.7) AS p70 FROM pred)
SELECT city, count(*) AS n_rows, round(avg(spike), 6) AS avg_value, min(spike) AS min_value, max(spike) AS max_value, round(quantile_cont(spike, 0.95), 6) AS p95_value
FROM pred, t WHERE y > p70 GROUP BY 1""")
def adjustments(spark, folder):
    marked = spike_threshold(stored_forecast(spark, folder)).where("is_spike")
    done = metrics.adjustment_stats(marked, "spike", ["city"])
    return done.withColumns({c: F.round(c, 6) for c in ("avg_value", "p95_value")})


@query("global_any", f"WITH {FORECAST_SQL} SELECT city, CASE WHEN bool_or(festival_flag * spike <> 0) THEN 1 ELSE 0 END::BIGINT AS adjusted FROM pred GROUP BY 1")
def any_nonzero(spark, folder):
    f = raw_forecast(spark, folder).withColumn("adjustment", F.col("festival_flag") * F.col("spike"))
    return any_adjustment(f, batch=["city"])


@query("mean_std", f"WITH {PANEL_SQL} SELECT count(aqi) AS n_scores, round(avg(aqi), 6) AS mean_score, round(stddev_pop(aqi), 6) AS std_score FROM panel")
def moments(spark, folder):
    return metrics.mean_std(panel(spark, folder), "aqi").withColumns({c: F.round(c, 6) for c in ("mean_score", "std_score")})


@query("average_forecast", f"WITH {FORECAST_SQL} SELECT hospital_id::BIGINT AS hospital_id, CAST(date_trunc('week', date)::DATE AS VARCHAR) AS week, count(*) AS n_rows, round(avg(q50), 6) AS mean_forecast FROM pred GROUP BY 1, 2")
def weekly(spark, folder):
    f = raw_forecast(spark, folder).withColumn("week", F.to_date(F.date_trunc("week", F.col("date").cast("timestamp"))))
    return relate.average_forecast(f, "q50", ["hospital_id", "week"]).withColumn("mean_forecast", F.round("mean_forecast", 6))


@query("sort_entity_time", f"WITH {PANEL_SQL} SELECT city, {KEY}, admissions FROM panel ORDER BY city, hospital_id, date")
def by_entity(spark, folder):
    return relate.sort_entity_time(panel(spark, folder).select("city", "hospital_id", "date", "admissions"))


@query("sort_time", f"WITH {PANEL_SQL} SELECT {KEY}, admissions FROM panel ORDER BY date, hospital_id")
def by_time(spark, folder):
    return relate.sort_time(panel(spark, folder).select("hospital_id", "date", "admissions"))


@query("top_k_residuals", f"""WITH {FORECAST_SQL}, r AS (SELECT *, round(y - q50, 9) AS residual, row_number() OVER (PARTITION BY city ORDER BY round(y - q50, 9) DESC, hospital_id, date) AS n FROM pred)
SELECT city, {KEY}, residual FROM r WHERE n <= 5""")
def top_residuals(spark, folder):
    r = residuals(raw_forecast(spark, folder)).withColumn("residual", F.round("residual", 9))
    return top_rows(r.select("city", "hospital_id", "date", "residual"), [F.desc("residual"), F.col("hospital_id"), F.col("date")], 5, ["city"])


@query("tail_rows", f"WITH {PANEL_SQL} SELECT {KEY}, admissions FROM panel ORDER BY panel.date DESC, panel.hospital_id DESC LIMIT 5")
def tail(spark, folder):
    return top_rows(panel(spark, folder).select("hospital_id", "date", "admissions"), [F.desc("date"), F.desc("hospital_id")], 5)


@query("first_record", f"""WITH {PANEL_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY hospital_id, date_trunc('month', date) ORDER BY date) AS r FROM panel)
SELECT hospital_id::BIGINT AS hospital_id, CAST(date_trunc('month', date)::DATE AS VARCHAR) AS month, CAST(date AS VARCHAR) AS date, aqi FROM n WHERE r = 1""")
def first(spark, folder):
    p = panel(spark, folder).select("hospital_id", F.trunc("date", "month").alias("month"), "date", "aqi")
    return relate.first_record(p, ["hospital_id", "month"], ["date"])


@query("union_entities", f"""WITH {PANEL_SQL}
SELECT city, {KEY}, admissions, aqi, -1.0::DOUBLE AS value FROM panel
UNION ALL SELECT event_type, user_id, CAST(CAST(ts AS DATE) AS VARCHAR), 0, -1.0, value FROM events""")
def union(spark, folder):
    p = panel(spark, folder).select("city", F.col("hospital_id").cast("bigint").alias("hospital_id"), "date", "admissions", "aqi")
    e = table(spark, folder, "events").select(F.col("event_type").alias("city"), F.col("user_id").alias("hospital_id"), F.to_date("ts").alias("date"), "value")
    return relate.union_entities(p, e).na.fill({"admissions": 0, "aqi": -1.0, "value": -1.0})
