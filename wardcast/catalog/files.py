"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardcast.catalog.registry import query
from wardcast.functions.fixed import fixed_row
from wardcast.operators.bands import score_mode
from wardcast.operators.clean import derive_entity_id
from wardcast.operators.decide import alert_digest, assemble_plan, monitored, plan_gaps
from wardcast.operators.windows import lead_covariates, time_index
from wardcast.plans.tables import (
    FORECAST_SQL, LAGGED_SQL, MONITORED_SQL, PANEL_SQL, lagged_panel, panel, plan_parts, raw_forecast, stored_forecast, stored_panel,
)
from wardcast.session import scratch_path, via_table
from wardcast.sources.readers import (
    payload_defaults, records_of, request_rejects, restamp_forecast_date, scan_all_entities, scan_entity_csv, scan_flat_csv,
    scan_forecast_layout, scan_json_payload, scan_rejects, table,
)
from wardcast.sources.schemas import FORECAST_PANEL, PANEL, RECORD
from wardcast.sources.writers import prediction_records, sink_csv_by_entity, sink_plan_json

AS_OF = "2025-12-05 10:30:00"
SHOWN = ["hospital_id", "date", "city", "admissions", "lag_1_admissions", "rolling_14_admissions", "aqi", "temp", "outbreak_index", "is_weekend"]
SHOWN_SQL = (
    "CAST(hospital_id AS VARCHAR) AS hospital_id, CAST(date AS VARCHAR) AS date, {city} AS city, admissions, "
    "CAST(lag_1_admissions AS BIGINT) AS lag_1_admissions, rolling_14_admissions, aqi, temp, outbreak_index, CAST(is_weekend AS BIGINT) AS is_weekend"
)
CASED = "upper(city[1]) || lower(substr(city, 2))"


def as_of():
    return F.to_timestamp(F.lit(AS_OF))


#: A city's file, of one part or of many.
_CITY_FILE = "regexp_extract(file, '([^/=]+_xgb[.]csv)', 1)"


def _panel_files(spark, folder):
    base = scratch_path(spark, "csv")
    cells = [F.col(f.name).cast(f.dataType).alias(f.name) for f in PANEL]
    sink_csv_by_entity(lagged_panel(spark, folder).select(*cells), base)
    return base


@query("scan_entity_csv", f"WITH {LAGGED_SQL} SELECT {SHOWN_SQL.format(city='city')} FROM lagged WHERE lower(city) = 'asia'")
def scan_entity(spark, folder):
    return scan_entity_csv(spark, _panel_files(spark, folder), "Asia").select(*SHOWN)


@query("scan_all_entities", f"WITH {LAGGED_SQL} SELECT {SHOWN_SQL.format(city=CASED)} FROM lagged")
def scan_all(spark, folder):
    return scan_all_entities(spark, _panel_files(spark, folder)).select(*SHOWN)


@query("sink_csv_by_entity", f"""WITH {LAGGED_SQL}
SELECT lower(city) AS city, count(*) AS n_rows, CAST(sum(admissions) AS BIGINT) AS admissions, CAST(min(date) AS VARCHAR) AS first_date
FROM lagged GROUP BY 1""")
def sink_entity(spark, folder):
    back = scan_all_entities(spark, _panel_files(spark, folder), skip_bad=False)
    return back.groupBy(F.lower("city").alias("city")).agg(
        F.count("*").alias("n_rows"), F.sum("admissions").alias("admissions"), F.min("date").alias("first_date"))


LEADS = [f"{c}_forecast_{h}" for h in range(1, 8) for c in ("aqi", "temp", "rainfall")]
LEADS_SQL = ", ".join(
    f"coalesce(max({c}) OVER (PARTITION BY hospital_id ORDER BY date RANGE BETWEEN INTERVAL {h} DAY FOLLOWING AND INTERVAL {h} DAY FOLLOWING), -9999) AS {c}_forecast_{h}"
    for h in range(1, 8) for c in ("aqi", "temp", "rainfall")
)


@query("scan_forecast_layout", f"""WITH {LAGGED_SQL}
SELECT CAST(hospital_id AS VARCHAR) AS hospital_id, CAST(date AS VARCHAR) AS date, {CASED} AS city,
       CAST(date - (SELECT min(date) FROM panel) AS BIGINT) AS time_idx, lag_7_admissions, {LEADS_SQL} FROM lagged""")
def scan_forecast(spark, folder):
    base = scratch_path(spark, "csv")
    wide = time_index(lead_covariates(via_table(lagged_panel(spark, folder), "panel"))).withColumn("group_id", F.col("hospital_id"))
    cells = [F.col(f.name).cast(f.dataType).alias(f.name) for f in FORECAST_PANEL]
    sink_csv_by_entity(wide.select("city", *cells), base, "tft", keep_city=False)
    back = derive_entity_id(scan_forecast_layout(spark, base))
    return back.select("hospital_id", "date", "city", "time_idx", "lag_7_admissions", *[F.coalesce(c, F.lit(-9999.0)).alias(c) for c in LEADS])


@query("scan_flat_csv", f"WITH {LAGGED_SQL} SELECT {SHOWN_SQL.format(city='city')} FROM lagged")
def scan_flat(spark, folder):
    path = scratch_path(spark, "flat")
    cells = [F.col(f.name).cast(f.dataType).alias(f.name) for f in PANEL]
    lagged_panel(spark, folder).select(*cells).write.option("header", True).csv(path)
    return scan_flat_csv(spark, path).select(*SHOWN)


@query("scan_json_payload", f"""WITH {PANEL_SQL}
SELECT CASE WHEN hospital_id % 2 = 0 THEN 'xgb' ELSE 'ensemble' END AS mode, CAST(0.6 AS DOUBLE) AS weight_tft,
       CAST(hospital_id AS VARCHAR) AS hospital_id, CAST(0.5 AS DOUBLE) AS disease_sensitivity, CAST(date AS VARCHAR) AS date,
       admissions, aqi, rainfall, CAST(staff_count AS BIGINT) AS staff_count
FROM panel""")
def scan_payload(spark, folder):
    """One request per hospital and month, at most 31 records each."""
    path = scratch_path(spark, "requests")
    record = F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in RECORD])
    requests = panel(spark, folder).groupBy("hospital_id", F.trunc("date", "month").alias("month")).agg(F.collect_list(record).alias("data"))
    requests.select(
        F.when(F.col("hospital_id") % 2 == 0, F.lit("xgb")).alias("mode"), F.col("hospital_id").cast("string").alias("hospital_id"), "data"
    ).write.json(path)
    return scan_json_payload(spark, path).select(
        "mode", "weight_tft", "hospital_id", "disease_sensitivity", "date", "admissions", "aqi", "rainfall", "staff_count")


def _panel_rows(spark, folder):
    return lagged_panel(spark, folder).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in PANEL])


@query("scan_rejects", f"""WITH {LAGGED_SQL},
ok AS (SELECT count(*) AS n FROM lagged), bad AS (SELECT count(*) AS n FROM lagged WHERE city = 'ASIA' AND k % 2 = 0)
SELECT 'unreadable rows' AS reason, 1::BIGINT AS files, (SELECT n FROM bad) AS rows, (SELECT n FROM ok) AS loaded
UNION ALL SELECT 'no row in the expected layout', 1, 0, (SELECT n FROM ok)""")
def rejects(spark, folder):
    """Beside the cities: a file whose dates are no dates in some rows, and one of another layout."""
    base = _panel_files(spark, folder)
    asia = lagged_panel(spark, folder).where("city = 'ASIA' and k % 2 = 0").select(
        *[(F.lit("someday") if f.name == "date" else F.col(f.name).cast(f.dataType)).alias(f.name) for f in PANEL])
    asia.write.option("header", True).csv(f"{base}/broken_xgb.csv")
    _panel_rows(spark, folder).select("date", "city").write.option("header", True).csv(f"{base}/other_xgb.csv")
    found = scan_rejects(spark, base).groupBy("reason").agg(F.countDistinct(F.expr(_CITY_FILE)).alias("files"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))
    return found.withColumn("loaded", F.lit(scan_all_entities(spark, base).count()))


@query("ingest_panel", f"""WITH {LAGGED_SQL}, two AS (SELECT count(*) AS n FROM lagged WHERE city = 'ASIA')
SELECT count(*) AS n_rows, CAST(min(date) AS VARCHAR) AS first_date, CAST(max(date) AS VARCHAR) AS last_date, count(DISTINCT hospital_id) AS n_hospitals, CAST(sum(admissions) AS BIGINT) AS admissions,
  any_value(n) AS duplicate_keys, 2 * any_value(n) AS duplicate_rows, any_value(n) AS surplus_rows, 1::BIGINT AS files_left_out FROM lagged, two""")
def ingested(spark, folder):
    """The files of all cities, one of another layout, and a later one that repeats a city's days with other admissions: the first rows stay."""
    from wardcast.plans.ingest import ingest

    base = _panel_files(spark, folder)
    again = _panel_rows(spark, folder).where("city = 'ASIA'").withColumn("admissions", F.col("admissions") + 1000)
    again.write.option("header", True).csv(f"{base}/zz_again_xgb.csv")
    _panel_rows(spark, folder).select("date", "city").write.option("header", True).csv(f"{base}/other_xgb.csv")
    done = ingest(spark, base)
    left = done.rejects.agg(F.countDistinct(F.expr(_CITY_FILE)).alias("files_left_out"))
    total = done.panel.agg(F.sum("admissions").cast("bigint").alias("admissions"))
    rows = [fixed_row(x).alias(n) for x, n in ((done.profile.drop("n_cities"), "p"), (total, "t"), (done.duplicates, "d"), (left, "l"))]
    return spark.range(1).select(*rows).select("p.*", "t.*", "d.*", "l.*")


_KINDS = """CASE hospital_id % 6 WHEN 0 THEN 'no readable data' WHEN 1 THEN 'not JSON' WHEN 2 THEN 'missing columns: aqi, rainfall' ELSE 'good' END"""


def request_files(spark, folder):
    """One request per hospital and month, at most 31 records; by hospital some have no data, are cut off, or lack columns; good ones start with blank lines."""
    path = scratch_path(spark, "requests")
    record = F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in RECORD])
    h = F.col("hospital_id") % 6
    months = panel(spark, folder).groupBy("hospital_id", F.trunc("date", "month").alias("month")).agg(F.sort_array(F.collect_list(record)).alias("data"))
    whole = F.to_json(F.struct(F.when(F.col("hospital_id") % 2 == 0, F.lit("xgb")).alias("mode"), F.col("month").cast("string").alias("disease"), "data"))
    lacking = F.to_json(F.struct(F.transform("data", lambda r: r.dropFields("aqi", "rainfall")).alias("data"), F.concat_ws("/", "hospital_id", "month").alias("request_id")))
    text = (
        F.when(h == 0, F.concat(F.lit('{"request_id": "'), F.concat_ws("/", "hospital_id", "month"), F.lit('", "data": []}')))
        .when(h == 1, F.left(whole, F.length(whole) - 3)).when(h == 2, lacking).otherwise(F.concat(F.lit(" \t"), whole))
    )
    months.select(text).write.text(path)
    return path


@query("request_rejects", f"""WITH {PANEL_SQL}, months AS (SELECT DISTINCT hospital_id, date_trunc('month', date) AS month FROM panel)
SELECT {_KINDS} AS reason, count(*) AS requests FROM months GROUP BY 1""")
def rejected_requests(spark, folder):
    """Good and rejected requests together are all requests."""
    path = request_files(spark, folder)
    bad = request_rejects(spark, path).groupBy("reason").agg(F.count("*").alias("requests"))
    good = scan_json_payload(spark, path).agg(F.lit("good").alias("reason"), F.countDistinct("request_id").alias("requests")).where("requests > 0")
    return bad.unionByName(good)


@query("request_lags", f"""WITH {PANEL_SQL}, good AS (SELECT *, row_number() OVER (PARTITION BY hospital_id, date_trunc('month', date) ORDER BY date) - 1 AS position FROM panel WHERE hospital_id % 6 > 2),
lags AS (SELECT *, lag(admissions, 1) OVER w AS a, lag(admissions, 7) OVER w AS b, first_value(admissions) OVER w AS f, avg(admissions) OVER (w ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS r
  FROM good WINDOW w AS (PARTITION BY hospital_id, date_trunc('month', date) ORDER BY date))
SELECT CAST(date AS VARCHAR) AS date, position::BIGINT AS position, admissions, aqi, CAST(coalesce(a, f) AS DOUBLE) AS lag_1_admissions, CAST(coalesce(b, f) AS DOUBLE) AS lag_7_admissions, round(r, 6) AS rolling_14_admissions FROM lags""")
def lags_of_requests(spark, folder):
    """No request names a hospital, so all share the default one; lags stay within each request."""
    from wardcast.plans.requests import request_lags

    done = request_lags(scan_json_payload(spark, request_files(spark, folder)))
    return done.select("date", "position", "admissions", "aqi", "lag_1_admissions", "lag_7_admissions", F.round("rolling_14_admissions", 6).alias("rolling_14_admissions"))


@query("sink_written_twice", f"""WITH {LAGGED_SQL} SELECT lower(city) AS city, count(*) AS n_rows FROM lagged GROUP BY 1""")
def sink_twice(spark, folder):
    """A city file written again replaces the first; the others stay."""
    base = _panel_files(spark, folder)
    sink_csv_by_entity(_panel_rows(spark, folder).where("city = 'ASIA'"), base)
    return scan_all_entities(spark, base).groupBy(F.lower("city").alias("city")).agg(F.count("*").alias("n_rows"))


@query("plan_gaps", f"""WITH {PANEL_SQL} SELECT count(*) AS plans, CAST(count(*) FILTER (WHERE k % 7 = 0) AS BIGINT) AS no_staffing,
CAST(count(*) FILTER (WHERE k % 11 = 0) AS BIGINT) AS no_supplies, 0::BIGINT AS no_advisory FROM panel""")
def gaps(spark, folder):
    """Forecast rows without staffing or supplies keep their plans."""
    scored = via_table(score_mode(stored_forecast(spark, folder), "xgb"), "scored")
    staffing, supplies, advisory = plan_parts(scored)
    keys = scored.select("hospital_id", "date", "k")
    staffing, supplies = (p.join(keys.where(f"k % {m} != 0").drop("k"), ["hospital_id", "date"], "left_semi") for p, m in ((staffing, 7), (supplies, 11)))
    return plan_gaps(assemble_plan(monitored(scored), staffing, supplies, advisory, as_of()))


@query("normalize_json_shape", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_shapes(spark, folder):
    p, kind = F.col("props"), F.col("event_id") % 4
    text = (
        F.when(kind == 0, F.concat(F.lit("["), p, F.lit("]")))
        .when(kind == 1, F.concat(F.lit('{"data": ['), p, F.lit("]}")))
        .when(kind == 2, F.concat(F.lit('{"records": ['), p, F.lit("]}")))
        .otherwise(p)
    )
    from pyspark.sql import types as T

    opened = table(spark, folder, "events").select("event_id", F.explode_outer(records_of(text, T.StructType.fromDDL("k bigint"))).alias("r"))
    return opened.select("event_id", "r.k")


@query("payload_defaults", """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'ensemble' ELSE 'xgb' END AS mode, CAST(CASE WHEN event_id % 4 = 0 THEN 0.6 ELSE 0.25 END AS DOUBLE) AS weight_tft,
  CASE WHEN event_id % 5 = 0 THEN 'HOSP-001' ELSE event_type END AS hospital_id, CAST(CASE WHEN event_id % 7 = 0 THEN 0.5 ELSE 0.9 END AS DOUBLE) AS disease_sensitivity
FROM events""")
def defaults(spark, folder):
    e = F.col("event_id")
    gaps = table(spark, folder, "events").select(
        "event_id", F.when(e % 3 != 0, F.lit("xgb")).alias("mode"), F.when(e % 4 != 0, F.lit(0.25)).alias("weight_tft"),
        F.when(e % 5 != 0, F.col("event_type")).alias("hospital_id"), F.when(e % 7 != 0, F.lit(0.9)).alias("disease_sensitivity"))
    return payload_defaults(gaps)


@query("restamp_forecast_date", f"""WITH {PANEL_SQL}
SELECT CAST(hospital_id AS BIGINT) AS hospital_id, CAST(k AS BIGINT) AS k, CAST((SELECT max(date) FROM panel) + 1 AS VARCHAR) AS date FROM panel""")
def restamp(spark, folder):
    p = stored_panel(spark, folder)
    return restamp_forecast_date(p, fixed_row(p.agg(F.max("date").alias("last")))["last"]).select("hospital_id", "k", "date")


def plans(spark, folder):
    scored = score_mode(stored_forecast(spark, folder), "ensemble")
    staffing, supplies, advisory = plan_parts(scored)
    return assemble_plan(monitored(scored), staffing, supplies, advisory, as_of())


BANDED_SQL = MONITORED_SQL + """,
plans AS (
  SELECT hospital_id, date, alert_level, urgency, factors, k,
         CAST(0.6 AS DOUBLE) * (aqi * CAST(0.95 AS DOUBLE) + temp) + (CAST(1.0 AS DOUBLE) - CAST(0.6 AS DOUBLE)) * q50 AS inflow
  FROM monitored JOIN adjusted USING (hospital_id, date))"""
ADJUSTED_SQL = """,
t AS (SELECT count(*) AS n, quantile_cont(rainfall, 0.9) AS s90, quantile_cont(rainfall, 0.95) AS s95, quantile_cont(rainfall, 0.99) AS s99,
      quantile_cont(wind_speed * 2, 0.9) AS e90, quantile_cont(wind_speed * 2, 0.95) AS e95, quantile_cont(wind_speed * 2, 0.99) AS e99 FROM panel),
adjusted AS (
  SELECT hospital_id, date, aqi + (0.0
    + rainfall * CASE WHEN n > 10 THEN (CASE WHEN rainfall > s99 THEN 4.0 WHEN rainfall > s95 THEN 3.0 WHEN rainfall > s90 THEN 2.0 ELSE 1.0 END)
                 ELSE (CASE WHEN rainfall > 60 THEN 4.0 WHEN rainfall > 30 THEN 2.0 ELSE 1.0 END) END
    + wind_speed * 2 * CASE WHEN n > 10 THEN (CASE WHEN wind_speed * 2 > e99 THEN 8.0 WHEN wind_speed * 2 > e95 THEN 6.5 WHEN wind_speed * 2 > e90 THEN 5.0 ELSE 1.0 END)
                 ELSE (CASE WHEN wind_speed * 2 > 40 THEN 8.0 WHEN wind_speed * 2 > 20 THEN 5.0 ELSE 1.0 END) END) AS q50
  FROM panel, t)"""
PLANS_SQL = BANDED_SQL.replace(",\nplans AS", ADJUSTED_SQL + ",\nplans AS", 1)


def fixed_sql(value, digits):
    return f"CAST(CAST(floor(({value}) * {float(10 ** digits)} + CAST(0.5000001 AS DOUBLE)) / {float(10 ** digits)} AS DECIMAL(18,{digits})) AS VARCHAR)"


@query("sink_plan_json", f"""WITH {PLANS_SQL}
SELECT sha256(hospital_id || '/' || CAST(date AS VARCHAR)) AS request_id, '2025-12-05' AS run_date, CAST(hospital_id AS VARCHAR) AS hospital,
       alert_level, urgency, CAST(k % 60 AS BIGINT) AS doctors, {fixed_sql('inflow', 4)} AS inflow FROM plans""")
def plan_files(spark, folder):
    path = scratch_path(spark, "plans")
    done = plans(spark, folder)
    sink_plan_json(done.select("plan"), path, as_of())
    back = spark.read.schema(done.select("plan").schema.add("run_date", "date")).json(path)
    from wardcast.functions.scalars import fixed_point

    return back.select(
        F.col("plan.requestId").alias("request_id"), "run_date", F.col("plan.hospitalId").alias("hospital"),
        F.col("plan.monitorReport.alertLevel").alias("alert_level"), F.col("plan.monitorReport.recommendedUrgency").alias("urgency"),
        F.col("plan.staffingPlan.doctorsNeeded").alias("doctors"), fixed_point(F.col("plan.predictedInflow"), 4).cast("string").alias("inflow"))


@query("sink_prediction_records", f"""WITH {FORECAST_SQL}
SELECT hospital_id::BIGINT AS hospital_id, '{{"date":"' || CAST(date AS VARCHAR) || '","lower":' || {fixed_sql('least(q10, q50 - 1.0)', 6)}
       || ',"median":' || {fixed_sql('q50', 6)} || ',"upper":' || {fixed_sql('greatest(q90, q50 + 1.0)', 6)} || '}}' AS record,
       count(*) OVER (PARTITION BY city) AS count FROM pred""")
def prediction_json(spark, folder):
    from wardcast.operators.bands import order_bands
    from wardcast.sources.writers import prediction_summary

    bands = order_bands(raw_forecast(spark, folder).withColumn("median", F.col("q50")), 1.0)
    return prediction_records(bands).join(prediction_summary(bands, "city"), "city").select("hospital_id", "record", "count")


@query("alert_digest", f"""WITH {PLANS_SQL}
SELECT 'Operational plan - ' || hospital_id AS title, upper(alert_level) AS alert_level, {fixed_sql('inflow', 2)} AS inflow,
       CAST(hospital_id AS VARCHAR) AS hospital, '2025-12-05 10:30:00' AS time FROM plans""")
def digest(spark, folder):
    return alert_digest(plans(spark, folder), as_of())
