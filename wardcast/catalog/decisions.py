"""Decision layer and structured text."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardcast.catalog.files import PLANS_SQL, as_of, fixed_sql, plans
from wardcast.catalog.registry import query
from wardcast.operators import decide as D
from wardcast.operators import text as X
from wardcast.plans.tables import ANSWERS_SQL, MONITORED_SQL, answers, panel, plan_parts

KEY = "hospital_id::BIGINT AS hospital_id, CAST(date AS VARCHAR) AS date"


@query("weather_risk", f"WITH {MONITORED_SQL} SELECT {KEY}, weather_score FROM scores")
def weather(spark, folder):
    risk = D.weather_risk(F.col("rainfall"), F.col("temp"), F.col("humidity"))
    return panel(spark, folder).select("hospital_id", "date", risk.alias("weather_score"))


@query("monitor_inputs", f"""WITH {MONITORED_SQL}
SELECT {KEY}, CASE WHEN k % 5 = 0 THEN 100.0 ELSE aqi END::DOUBLE AS aqi_score, festival_score::DOUBLE AS festival_score, weather_score,
  CASE WHEN k % 3 = 0 THEN 0.5 ELSE least(1.0, CAST(k % 7 AS DOUBLE) / 5) END::DOUBLE AS sensitivity_score FROM scores""")
def inputs(spark, folder):
    k = F.col("k")
    gaps = panel(spark, folder).withColumn("aqi", F.when(k % 5 != 0, F.col("aqi")))
    done = D.monitor_inputs(gaps, F.when(k % 3 != 0, (k % 7).cast("double") / 5))
    return done.select("hospital_id", "date", "aqi_score", "festival_score", "weather_score", "sensitivity_score")


@query("risk_alert", f"WITH {MONITORED_SQL} SELECT {KEY}, alert_level, urgency FROM monitored")
def alert(spark, folder):
    return D.monitored(panel(spark, folder)).select("hospital_id", "date", "alert_level", "urgency")


@query("risk_factors", f"WITH {MONITORED_SQL} SELECT {KEY}, factors AS risk_factors FROM monitored")
def factors(spark, folder):
    return D.monitored(panel(spark, folder)).select("hospital_id", "date", "risk_factors")


@query("recommended_actions", f"""WITH {MONITORED_SQL}
SELECT {KEY}, concat_ws('|', 'Notify respiratory teams about alert level ' || alert_level, 'Stage ' || (k % 200) || ' oxygen cylinders near ER',
  CASE WHEN urgency IN ('activate surge', 'emergency') THEN 'Activate surge bed protocol and inform city EMS' END,
  CASE WHEN k % 60 > 40 THEN 'Call in locum physicians for night shift coverage' END) AS actions FROM monitored""")
def actions(spark, folder):
    staffing, supplies, _ = plan_parts(panel(spark, folder))
    done = D.monitored(panel(spark, folder)).join(staffing, ["hospital_id", "date"]).join(supplies, ["hospital_id", "date"])
    return done.select("hospital_id", "date", D.recommended_actions().alias("actions"))


@query("assemble_plan", f"""WITH {PLANS_SQL}
SELECT {KEY}, sha256(hospital_id || '/' || CAST(date AS VARCHAR)) AS request_id, alert_level, factors AS risk_factors, urgency,
  CAST(k % 60 AS BIGINT) AS doctors, CAST(k % 200 AS BIGINT) AS cylinders, 'saline|paracetamol' AS medicines, 'Wear a mask outdoors' AS advisory,
  2 + CASE WHEN urgency IN ('activate surge', 'emergency') THEN 1 ELSE 0 END + CASE WHEN k % 60 > 40 THEN 1 ELSE 0 END::BIGINT AS n_actions,
  5::BIGINT AS n_trace, {fixed_sql('inflow', 4)} AS inflow FROM plans""")
def plan(spark, folder):
    from wardcast.functions.scalars import fixed_point

    p = F.col("plan")
    return plans(spark, folder).select(
        "hospital_id", "date", p["requestId"].alias("request_id"), p["monitorReport"]["alertLevel"].alias("alert_level"),
        p["monitorReport"]["riskFactors"].alias("risk_factors"), p["monitorReport"]["recommendedUrgency"].alias("urgency"),
        p["staffingPlan"]["doctorsNeeded"].alias("doctors"), p["suppliesPlan"]["oxygenCylinders"].alias("cylinders"),
        p["suppliesPlan"]["commonMedicines"].alias("medicines"), p["advisory"]["publicAdvisory"].alias("advisory"),
        F.size(p["recommendedActions"]).alias("n_actions"), F.size(p["agentTrace"]).alias("n_trace"),
        fixed_point(p["predictedInflow"], 4).cast("string").alias("inflow"))


@query("plan_trace", f"""WITH {MONITORED_SQL}
SELECT {KEY}, step::BIGINT AS step, CASE step WHEN 0 THEN 'prediction_api' WHEN 1 THEN 'monitor' WHEN 2 THEN 'staffing_planner' WHEN 3 THEN 'supplies_planner' ELSE 'advisory' END AS agent,
  CASE step WHEN 0 THEN 'Fetched predictions' WHEN 1 THEN 'Alert ' || alert_level WHEN 2 THEN 'Staffing plan ready' WHEN 3 THEN 'Supplies plan ready' ELSE 'Advisory drafted' END AS message,
  '2025-12-05 10:30:00' AS timestamp FROM monitored, (SELECT unnest([0, 1, 2, 3, 4]) AS step)""")
def trace(spark, folder):
    rows = D.monitored(panel(spark, folder)).select("hospital_id", "date", F.posexplode(D.plan_trace(as_of())).alias("step", "e"))
    return rows.select("hospital_id", "date", "step", "e.agent", "e.message", F.date_format("e.timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp"))


@query("fan_out_entities", f"""WITH {PLANS_SQL}
SELECT CAST(hospital_id AS VARCHAR) AS hospital, count(*) AS plans, CAST(count(*) FILTER (WHERE alert_level = 'critical') AS BIGINT) AS critical,
  CAST(sum(k % 60) AS BIGINT) AS doctors FROM plans GROUP BY 1""")
def fan_out(spark, folder):
    p = F.col("plan")
    return plans(spark, folder).groupBy(p["hospitalId"].alias("hospital")).agg(
        F.count("*").alias("plans"), F.count_if(p["monitorReport"]["alertLevel"] == "critical").alias("critical"),
        F.sum(p["staffingPlan"]["doctorsNeeded"]).alias("doctors"))


@query("alert_rollup", f"WITH {MONITORED_SQL} SELECT CAST(date AS VARCHAR) AS date, alert_level, count(*) AS plans FROM monitored GROUP BY 1, 2")
def rollup(spark, folder):
    return D.alert_rollup(D.monitored(panel(spark, folder)))


def _template_sql(name: str) -> str:
    text = X.TEMPLATES[name].replace("'", "''")
    places = {
        "aqi": fixed_sql("aqi", 2), "festival_score": fixed_sql("festival_score", 2), "weather_risk": fixed_sql("weather_score", 2),
        "disease_sensitivity": fixed_sql("sensitivity_score", 2), "predicted_inflow": fixed_sql("admissions", 1),
        "alert_level": "alert_level", "risk_factors": "replace(factors, '|', ', ')",
    }
    for place, value in places.items():
        text = text.replace("{" + place + "}", f"' || {value} || '")
    return f"'{text}'"


@query("render_prompts", f"WITH {MONITORED_SQL} SELECT {KEY}, " + ", ".join(f"{_template_sql(n)} AS {n}_prompt" for n in X.TEMPLATES) + " FROM monitored")
def prompts(spark, folder):
    done = X.render_prompts(D.monitored(panel(spark, folder)), "admissions")
    return done.select("hospital_id", "date", *[f"{n}_prompt" for n in X.TEMPLATES])


BLOCK_SQL = """,
blocks AS (SELECT *, nullif(trim(replace(regexp_extract(CASE WHEN regexp_matches(answer, '```(?:json)?(.*?)```', 'is') THEN regexp_extract(answer, '```(?:json)?(.*?)```', 1, 'is') ELSE answer END,
  '\\{.*\\}', 0, 's'), 'end_of_range=', '')), '') AS block FROM answers),
parsed AS (SELECT *, CASE WHEN json_valid(answer) THEN 'raw' WHEN json_valid(block) THEN 'repaired' ELSE 'failed' END AS parse_status,
  CASE WHEN json_valid(answer) THEN answer WHEN json_valid(block) THEN block END AS doc FROM blocks)"""


@query("extract_json_block", f"WITH {ANSWERS_SQL}{BLOCK_SQL} SELECT {KEY}, coalesce(block, 'none') AS block FROM blocks")
def block(spark, folder):
    return answers(spark, folder).select("hospital_id", "date", F.coalesce(X.extract_json_block(F.col("answer")), F.lit("none")).alias("block"))


@query("parse_structured", f"""WITH {ANSWERS_SQL}{BLOCK_SQL}
SELECT {KEY}, parse_status, coalesce(json_extract_string(doc, '$.alertLevel'), 'none') AS alert_level, coalesce(json_extract_string(doc, '$.recommendedUrgency'), 'none') AS urgency,
  coalesce(array_to_string(CAST(json_extract(doc, '$.riskFactors') AS VARCHAR[]), '|'), 'none') AS risk_factors FROM parsed""")
def parse(spark, folder):
    done, none = X.parse_structured(answers(spark, folder), "answer"), F.lit("none")
    return done.select(
        "hospital_id", "date", "parse_status", F.coalesce("parsed.alertLevel", none).alias("alert_level"), F.coalesce("parsed.recommendedUrgency", none).alias("urgency"),
        F.when(F.col("parsed").isNull(), none).otherwise(F.concat_ws("|", "parsed.riskFactors")).alias("risk_factors"))


@query("parse_or_rule", f"""WITH {ANSWERS_SQL}{BLOCK_SQL}
SELECT {KEY}, CASE WHEN doc IS NULL OR festival_flag = 1 THEN 'rule' ELSE 'answer' END AS decided_by, alert_level, urgency, factors AS risk_factors FROM parsed""")
def answer_or_rule(spark, folder):
    """Festival days carry an answer with an unknown label, which must fall back to the rule."""
    odd = F.regexp_replace("answer", '"alertLevel":"[a-z]+"', '"alertLevel":"severe"')
    rows = answers(spark, folder).withColumn("answer", F.when(F.col("festival_flag") == 1, odd).otherwise(F.col("answer")))
    return X.parse_or_rule(rows, "answer").select("hospital_id", "date", "decided_by", "alert_level", "urgency", "risk_factors")
