"""Views that bring the star-schema and event tables into panel shape."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardcast.functions.calendar import weekday_of
from wardcast.functions.scalars import flag
from wardcast.session import via_table
from wardcast.sources.readers import table


def cents(amount: Column) -> Column:
    return F.round(amount * 100).cast("bigint")


def panel(spark: SparkSession, folder: str) -> DataFrame:
    """One row per hospital (customer) and order day, cities being regions, so that rows and hospitals grow with the tables.

    Admissions are the orders of the day and a part of their price. Measures come from whole-number sums, so they do not depend on the order of addition.
    The rollup is a partial and a final hash aggregate on (hospital, day).
    """
    orders = table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("date"), cents(F.col("o_totalprice")).alias("price")
    )
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey", cents(F.col("c_acctbal")).alias("balance"))
    daily = (
        orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_custkey", "c_nationkey", "date")
        .agg(
            F.count("*").alias("n"), F.max("o_orderkey").alias("k"),
            F.sum("price").alias("price"), F.sum("balance").alias("balance"),
        )
    )
    nations = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    nations = nations.select("n_nationkey", "n_regionkey", "r_name")
    h, k, admissions = F.col("c_custkey"), F.col("k"), F.expr("n + price div 1000000")
    aqi = F.expr("price div (1000 * n)").cast("double") / 100.0
    temp = F.expr("(balance + 100000 * n) div (250 * n)").cast("double") / 100.0 - 4.0
    day = weekday_of(F.col("date"))
    return daily.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "date", F.col("r_name").alias("city"), F.col("n_regionkey").alias("city_id"), h.alias("hospital_id"),
        F.floor(h / 5).cast("int").alias("hospital_id_enc"), admissions.alias("admissions"),
        aqi.alias("aqi"), temp.alias("temp"),
        (20 + k % 76).cast("double").alias("humidity"), (k % 61).cast("double").alias("rainfall"),
        (k % 20).cast("double").alias("wind_speed"), (20 + k % 91).cast("double").alias("mobility_index"),
        F.when(k % 111 == 0, F.lit(1.0)).when(k % 37 == 0, F.lit(0.4)).otherwise(F.lit(0.0)).alias("outbreak_index"),
        flag(k % 17 == 0).alias("festival_flag"), flag(k % 23 == 0).alias("holiday_flag"),
        day.alias("weekday"), flag(day >= 5).alias("is_weekend"),
        (9000 + 400 * h).alias("population_density"), (50 + 10 * h).alias("hospital_beds"), (20 + 5 * h).alias("staff_count"),
        k.alias("k"),
    )


PANEL_SQL = """
daily AS (
  SELECT c_custkey AS h, c_nationkey AS nation, CAST(o_orderdate AS DATE) AS date, count(*) AS n, max(o_orderkey) AS k,
         CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS price,
         CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS BIGINT) AS balance
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3),
panel AS (
  SELECT date, r_name AS city, n_regionkey AS city_id, h AS hospital_id, h // 5 AS hospital_id_enc, n + price // 1000000 AS admissions,
         CAST(price // (1000 * n) AS DOUBLE) / 100.0 AS aqi,
         CAST((balance + 100000 * n) // (250 * n) AS DOUBLE) / 100.0 - 4.0 AS temp,
         CAST(20 + k % 76 AS DOUBLE) AS humidity, CAST(k % 61 AS DOUBLE) AS rainfall,
         CAST(k % 20 AS DOUBLE) AS wind_speed, CAST(20 + k % 91 AS DOUBLE) AS mobility_index,
         CASE WHEN k % 111 = 0 THEN CAST(1.0 AS DOUBLE) WHEN k % 37 = 0 THEN CAST(0.4 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS outbreak_index,
         CASE WHEN k % 17 = 0 THEN 1 ELSE 0 END AS festival_flag, CASE WHEN k % 23 = 0 THEN 1 ELSE 0 END AS holiday_flag,
         isodow(date) - 1 AS weekday, CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS is_weekend,
         9000 + 400 * h AS population_density, 50 + 10 * h AS hospital_beds, 20 + 5 * h AS staff_count, k
  FROM daily JOIN nation ON daily.nation = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def raw_forecast(spark: SparkSession, folder: str) -> DataFrame:
    """Stand-in model outputs derived from the panel: quantiles, corrections, second model, target."""
    aqi = F.col("aqi")
    return panel(spark, folder).select(
        "hospital_id", "date", "city", aqi.alias("q50"),
        (aqi - F.col("humidity") / 4).alias("q10"), (aqi + F.col("humidity") / 4).alias("q90"),
        F.col("rainfall").alias("spike"), (F.col("wind_speed") * 2).alias("extreme"),
        (aqi * 0.95 + F.col("temp")).alias("second"), (aqi + (F.col("mobility_index") - 65) / 10).alias("y"),
        "festival_flag", "humidity", "rainfall", "temp", "aqi", "k", "admissions",
    )


def stored_forecast(spark: SparkSession, folder: str) -> DataFrame:
    """The forecast written once, for queries that read it in several passes."""
    return via_table(raw_forecast(spark, folder), "forecast")


def stored_panel(spark: SparkSession, folder: str) -> DataFrame:
    """The panel written once, for queries that read it in several passes."""
    return via_table(panel(spark, folder), "panel")


FORECAST_SQL = PANEL_SQL + """,
pred AS (
  SELECT hospital_id, date, city, aqi AS q50, aqi - humidity / 4 AS q10, aqi + humidity / 4 AS q90, rainfall AS spike,
         wind_speed * 2 AS extreme, aqi * CAST(0.95 AS DOUBLE) + temp AS second,
         aqi + (mobility_index - 65) / 10 AS y, festival_flag, humidity, rainfall, temp, aqi, k, admissions
  FROM panel)"""


def lagged_panel(spark: SparkSession, folder: str) -> DataFrame:
    from wardcast.operators.windows import lag_features

    return lag_features(panel(spark, folder))


LAGGED_SQL = PANEL_SQL + """,
lagged AS (
  SELECT *, coalesce(lag(admissions, 1) OVER w, first_value(admissions) OVER w) AS lag_1_admissions,
         coalesce(lag(admissions, 7) OVER w, first_value(admissions) OVER w) AS lag_7_admissions,
         round(avg(admissions) OVER (w ROWS BETWEEN 13 PRECEDING AND CURRENT ROW), 2) AS rolling_14_admissions
  FROM panel WINDOW w AS (PARTITION BY hospital_id ORDER BY date))"""


def answers(spark: SparkSession, folder: str) -> DataFrame:
    """Monitored panel with a written answer per row in four shapes: raw, fenced, noisy, none."""
    from wardcast.operators.decide import monitored

    quoted = F.concat(F.lit('["'), F.concat_ws('","', "risk_factors"), F.lit('"]'))
    body = F.concat(
        F.lit('{"alertLevel":"'), F.col("alert_level"), F.lit('","riskFactors":'), quoted,
        F.lit(',"recommendedUrgency":"'), F.col("urgency"), F.lit('"}'),
    )
    shape = F.col("hospital_id") % 4
    text = (
        F.when(shape == 0, body)
        .when(shape == 1, F.concat(F.lit("Here is the report:\n```json\n"), body, F.lit("\n```\nStay safe.")))
        .when(shape == 2, F.concat(F.lit("{end_of_range="), F.substr(body, F.lit(2)), F.lit(" thanks")))
        .otherwise(F.concat(F.lit("Alert is "), F.col("alert_level"), F.lit(" today.")))
    )
    return monitored(panel(spark, folder)).withColumn("answer", text)


MONITORED_SQL = PANEL_SQL + """,
scores AS (
  SELECT *, aqi AS aqi_score, greatest(0.0, least(1.0, CAST(festival_flag AS DOUBLE))) AS festival_score,
         greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), rainfall / 60 + greatest(temp - 35, 0) / 25 + (humidity - 70) / 40)) AS weather_score,
         CAST(0.5 AS DOUBLE) AS sensitivity_score
  FROM panel),
monitored AS (
  SELECT *,
    CASE WHEN aqi >= 300 THEN 'critical' WHEN aqi >= 200 THEN 'high' WHEN aqi >= 150 THEN 'moderate'
         WHEN festival_score > 0.6 OR weather_score > 0.6 THEN 'moderate' ELSE 'low' END AS alert_level,
    CASE WHEN aqi >= 300 THEN 'emergency' WHEN aqi >= 200 THEN 'activate surge' WHEN aqi >= 150 THEN 'prepare'
         WHEN festival_score > 0.6 OR weather_score > 0.6 THEN 'prepare' ELSE 'monitor' END AS urgency,
    coalesce(nullif(concat_ws('|',
      CASE WHEN aqi >= 300 THEN 'AQI >= 300 (hazardous air quality)' WHEN aqi >= 200 THEN 'AQI >= 200 (very unhealthy)'
           WHEN aqi >= 150 THEN 'AQI >= 150 (unhealthy)' END,
      CASE WHEN festival_score > 0.6 THEN 'Major festival / crowding risk' END,
      CASE WHEN weather_score > 0.6 THEN 'Adverse weather conditions' END), ''), 'No major risk factors detected') AS factors
  FROM scores)"""

ANSWERS_SQL = MONITORED_SQL + """,
bodies AS (
  SELECT *, '{"alertLevel":"' || alert_level || '","riskFactors":["' || replace(factors, '|', '","')
         || '"],"recommendedUrgency":"' || urgency || '"}' AS body FROM monitored),
answers AS (
  SELECT *, CASE hospital_id % 4 WHEN 0 THEN body
      WHEN 1 THEN 'Here is the report:' || chr(10) || '```json' || chr(10) || body || chr(10) || '```' || chr(10) || 'Stay safe.'
      WHEN 2 THEN '{end_of_range=' || substr(body, 2) || ' thanks'
      ELSE 'Alert is ' || alert_level || ' today.' END AS answer
  FROM bodies)"""


def plan_parts(forecast: DataFrame, keys: Sequence[str] = ("hospital_id", "date")) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written staffing, supplies and advisory tables for a forecast with column ``k``."""
    k = F.col("k")
    staffing = forecast.select(
        *keys, (k % 60).cast("int").alias("doctors_needed"), (k % 150).cast("int").alias("nurses_needed"),
        (k % 90).cast("int").alias("support_staff_needed"),
    )
    supplies = forecast.select(
        *keys, (k % 200).cast("int").alias("oxygen_cylinders"), (k % 300).cast("int").alias("beds"),
        F.array(F.lit("saline"), F.lit("paracetamol")).alias("common_medicines"),
        F.array(F.lit("salbutamol")).alias("special_medicines"),
    )
    advisory = forecast.select(
        *keys, F.lit("Wear a mask outdoors").alias("public_advisory"), F.lit("Breathing first").alias("triage_rules"),
        F.lit("Route mild cases to video").alias("teleconsultation"), F.lit("Nebulise on arrival").alias("pollution_care"),
    )
    return staffing, supplies, advisory
