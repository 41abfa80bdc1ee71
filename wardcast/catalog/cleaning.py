"""Validation and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardcast.catalog.registry import query
from wardcast.fixed_values import FEATURES, TRAINING_COLUMNS
from wardcast.operators import clean
from wardcast.operators.decide import monitored
from wardcast.operators.windows import fill_forward_back_zero
from wardcast.plans.tables import LAGGED_SQL, MONITORED_SQL, PANEL_SQL, lagged_panel, panel
from wardcast.sources.readers import table

_AUDITED = [*TRAINING_COLUMNS, "respiratory"]
_TEXT = {"date", "city"}


def _audit_sql(c):
    if c == "respiratory":
        return "SELECT 'respiratory' AS column_name, 0::BIGINT AS present, 0::BIGINT AS filled, (SELECT count(*) FROM lagged) AS nulls, -1.0::DOUBLE AS low, -1.0::DOUBLE AS high"
    number = "-1.0::DOUBLE" if c in _TEXT else "{0}(CAST(" + c + " AS DOUBLE))"
    return (f"SELECT '{c}', 1::BIGINT, count({c}), count(*) - count({c}), {number.format('min')}, {number.format('max')} FROM lagged")


@query("column_audit", f"WITH {LAGGED_SQL} " + " UNION ALL ".join(_audit_sql(c) for c in reversed(_AUDITED)))
def audit(spark, folder):
    audit = clean.column_audit(lagged_panel(spark, folder), _AUDITED)
    return audit.withColumns({c: F.coalesce(c, F.lit(-1.0)) for c in ("low", "high")})


@query("validate_mode", """
SELECT event_type AS mode, CASE WHEN event_type IN ('xgb', 'tft', 'ensemble') THEN 1 ELSE 0 END::BIGINT AS valid, count(*) AS n_rows
FROM (SELECT CASE event_type WHEN 'click' THEN 'xgb' WHEN 'view' THEN 'tft' WHEN 'purchase' THEN 'ensemble' ELSE event_type END AS event_type FROM events)
GROUP BY 1, 2""")
def modes(spark, folder):
    e = F.col("event_type")
    mode = F.when(e == "click", F.lit("xgb")).when(e == "view", F.lit("tft")).when(e == "purchase", F.lit("ensemble")).otherwise(e)
    checked = clean.with_reasons(table(spark, folder, "events").select(mode.alias("mode")), clean.mode_rule())
    ok = clean.valid_rows(checked).groupBy("mode").agg(F.lit(1).alias("valid"), F.count("*").alias("n_rows"))
    return ok.union(clean.rejected_rows(checked).groupBy("mode").agg(F.lit(0).alias("valid"), F.count("*").alias("n_rows")))


@query("coerce_date", """
SELECT o_orderkey, coalesce(CAST(try_cast(t AS DATE) AS VARCHAR), 'unreadable') AS date
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS t FROM orders)""")
def dates(spark, folder):
    text = F.when(F.col("o_orderkey") % 10 == 0, F.lit("soon")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    read = clean.coerce_date(table(spark, folder, "orders").select("o_orderkey", text.alias("date")))
    return read.select("o_orderkey", F.coalesce(F.col("date").cast("string"), F.lit("unreadable")).alias("date"))


@query("coerce_numeric", """
SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 0 WHEN event_id % 11 = 0 THEN 0 ELSE value END::DOUBLE AS value FROM events""")
def numbers(spark, folder):
    e = F.col("event_id")
    text = F.when(e % 9 == 0, F.lit("n/a")).when(e % 11 == 0, F.lit(None).cast("string")).otherwise(F.col("value").cast("string"))
    return clean.coerce_numeric(table(spark, folder, "events").select("event_id", text.alias("value")), ["value"])


@query("range_constraints", f"""WITH {MONITORED_SQL}
SELECT hospital_id::BIGINT AS hospital_id, CAST(date AS VARCHAR) AS date,
  concat_ws('|', CASE WHEN NOT temp >= 0 THEN 'temp_negative' END, CASE WHEN NOT festival_score BETWEEN 0 AND 1 THEN 'festival_score_outside_0_1' END,
    CASE WHEN NOT raw_weather BETWEEN 0 AND 1 THEN 'raw_weather_outside_0_1' END) AS reject_reasons
FROM (SELECT *, rainfall / 60 + greatest(temp - 35, 0) / 25 + (humidity - 70) / 40 AS raw_weather FROM monitored)""")
def ranges(spark, folder):
    raw = F.col("rainfall") / 60 + F.greatest(F.col("temp") - 35, F.lit(0.0)) / 25 + (F.col("humidity") - 70) / 40
    scored = monitored(panel(spark, folder)).withColumn("raw_weather", raw)
    rules = clean.score_range_rules("temp", ["festival_score", "raw_weather"])
    return clean.with_reasons(scored, rules).select("hospital_id", "date", "reject_reasons")


@query("enum_constraints", f"""WITH {MONITORED_SQL}
SELECT level AS alert_level, urgency, count(*) AS n_rows, CASE WHEN level IN ('low', 'moderate', 'high', 'critical') THEN '' ELSE 'alert_level' END AS reject_reasons
FROM (SELECT CASE WHEN festival_flag = 1 THEN 'severe' ELSE alert_level END AS level, urgency FROM monitored) GROUP BY 1, 2""")
def labels(spark, folder):
    level = F.when(F.col("festival_flag") == 1, F.lit("severe")).otherwise(F.col("alert_level"))
    marked = clean.with_reasons(monitored(panel(spark, folder)).withColumn("alert_level", level), clean.vocabulary_rules())
    return marked.groupBy("alert_level", "urgency", "reject_reasons").agg(F.count("*").alias("n_rows"))


@query("count_duplicates", """
SELECT count(*) AS duplicate_keys, CAST(coalesce(sum(c), 0) AS BIGINT) AS duplicate_rows, CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS surplus_rows
FROM (SELECT count(*) AS c FROM orders GROUP BY o_custkey, CAST(o_orderdate AS DATE)) WHERE c > 1""")
def duplicates(spark, folder):
    orders = table(spark, folder, "orders").withColumn("date", F.to_date("o_orderdate"))
    return clean.count_duplicates(orders, ["o_custkey", "date"])


@query("dedup_keep_first", """
SELECT o_custkey, CAST(date AS VARCHAR) AS date, o_orderkey, o_totalprice, o_orderpriority FROM (
  SELECT *, CAST(o_orderdate AS DATE) AS date, row_number() OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE) ORDER BY o_totalprice, o_orderkey) AS r FROM orders)
WHERE r = 1""")
def dedup(spark, folder):
    orders = table(spark, folder, "orders").select("o_custkey", F.to_date("o_orderdate").alias("date"), "o_orderkey", "o_totalprice", "o_orderpriority")
    return clean.dedup_keep_first(orders, ["o_custkey", "date"], ["o_totalprice", "o_orderkey"])


@query("fill_forward_back_zero", f"""WITH {PANEL_SQL},
gaps AS (SELECT hospital_id, date, CASE WHEN hospital_id % 5 = 4 OR k % 3 = 0 THEN NULL ELSE aqi END AS aqi, CASE WHEN k % 4 > 0 THEN NULL ELSE rainfall END AS rainfall FROM panel)
SELECT hospital_id::BIGINT AS hospital_id, CAST(date AS VARCHAR) AS date,
  coalesce(last_value(aqi IGNORE NULLS) OVER p, first_value(aqi IGNORE NULLS) OVER f, 0) AS aqi,
  coalesce(last_value(rainfall IGNORE NULLS) OVER p, first_value(rainfall IGNORE NULLS) OVER f, 0) AS rainfall
FROM gaps WINDOW p AS (PARTITION BY hospital_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  f AS (PARTITION BY hospital_id ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
def fill(spark, folder):
    k = F.col("k")
    gaps = panel(spark, folder).select(
        "hospital_id", "date", F.when(~((F.col("hospital_id") % 5 == 4) | (k % 3 == 0)), F.col("aqi")).alias("aqi"),
        F.when(k % 4 == 0, F.col("rainfall")).alias("rainfall"))
    return fill_forward_back_zero(gaps, ["aqi", "rainfall"])


_MISSING = [c for c in FEATURES if c not in ("aqi", "temp", "humidity", "weekday")]


@query("add_missing_as_zero", f"""WITH {PANEL_SQL}
SELECT hospital_id::BIGINT AS hospital_id, CAST(date AS VARCHAR) AS date, aqi, {', '.join(f'0.0::DOUBLE AS {c}' for c in _MISSING)} FROM panel""")
def missing(spark, folder):
    return clean.add_missing_as_zero(panel(spark, folder).select("hospital_id", "date", "aqi"), _MISSING)


@query("derive_entity_id", f"""WITH {PANEL_SQL}
SELECT CAST(k AS BIGINT) AS k, city || '_' || hospital_id_enc AS by_code, city || '_' || (row_number() OVER (PARTITION BY city ORDER BY date, md5(CAST(k AS VARCHAR)), k) - 1) AS by_number FROM panel""")
def entity_ids(spark, folder):
    p = panel(spark, folder).drop("hospital_id")
    coded = clean.derive_entity_id(p).withColumnRenamed("hospital_id", "by_code")
    return clean.number_within(coded, "city", "k").select("k", "by_code", F.col("hospital_id").alias("by_number"))
