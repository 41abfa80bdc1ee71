import pytest
from pyspark.sql import functions as F

from wardcast.operators.decide import alert_digest, assemble_plan, monitored, recommended_actions

# aqi, temp, humidity, rainfall, festival, then the results worked out by hand
SAMPLES = [
    (240.0, 26.0, 70.0, 5.0, 1, 5 / 60, "high", "activate surge",
     ["AQI >= 200 (very unhealthy)", "Major festival / crowding risk"]),
    (120.0, 42.0, 85.0, 45.0, 0, 1.0, "moderate", "prepare", ["Adverse weather conditions"]),
    (180.0, 28.0, 65.0, 2.0, 1, 0.0, "moderate", "prepare", ["AQI >= 150 (unhealthy)", "Major festival / crowding risk"]),
    (350.0, 38.0, 75.0, 0.0, 0, 0.245, "critical", "emergency", ["AQI >= 300 (hazardous air quality)"]),
    (100.0, 20.0, 70.0, 0.0, 0, 0.0, "low", "monitor", ["No major risk factors detected"]),
    (None, None, None, 40.0, None, 0.0, "low", "monitor", ["No major risk factors detected"]),
    (149.99, 20.0, 70.0, 0.0, 1, 0.0, "moderate", "prepare", ["Major festival / crowding risk"]),
    (300.0, 20.0, 70.0, 60.0, 1, 1.0, "critical", "emergency",
     ["AQI >= 300 (hazardous air quality)", "Major festival / crowding risk", "Adverse weather conditions"]),
]


def frame(spark):
    rows = [(i, *s[:5]) for i, s in enumerate(SAMPLES)]
    return spark.createDataFrame(rows, "hospital_id int, aqi double, temp double, humidity double, rainfall double, festival_flag int")


def test_samples(spark):
    for row in monitored(frame(spark)).collect():
        risk, level, urgency, factors = SAMPLES[row["hospital_id"]][5:]
        assert row["weather_score"] == pytest.approx(risk)
        assert (row["alert_level"], row["urgency"], row["risk_factors"]) == (level, urgency, factors)


def test_sensitivity_default_and_clamp(spark):
    df = frame(spark).withColumn("s", F.when(F.col("hospital_id") == 0, F.lit(7.0)))
    got = {r["hospital_id"]: r["sensitivity_score"] for r in monitored(df, F.col("s")).collect()}
    assert got[0] == 1.0 and got[1] == 0.5


@pytest.mark.parametrize("urgency,doctors,expected", [
    ("monitor", 40, 2), ("monitor", 41, 3), ("activate surge", 40, 3), ("emergency", 99, 4),
])
def test_actions(spark, urgency, doctors, expected):
    df = spark.createDataFrame([("high", urgency, 12, doctors)], "alert_level string, urgency string, oxygen_cylinders int, doctors_needed int")
    actions = df.select(recommended_actions().alias("a")).first()["a"]
    assert len(actions) == expected
    assert actions[:2] == ["Notify respiratory teams about alert level high", "Stage 12 oxygen cylinders near ER"]


def test_plan_document(spark):
    df = monitored(frame(spark)).withColumns({"date": F.lit("2025-12-05").cast("date"), "median": F.lit(201.255)})
    keys = ["hospital_id", "date"]
    staffing = df.select(*keys, F.lit(50).alias("doctors_needed"), F.lit(9).alias("nurses_needed"), F.lit(3).alias("support_staff_needed"))
    supplies = df.select(*keys, F.lit(7).alias("oxygen_cylinders"), F.lit(5).alias("beds"), F.array(F.lit("x")).alias("common_medicines"), F.array(F.lit("y")).alias("special_medicines"))
    advisory = df.select(*keys, *[F.lit(c).alias(c) for c in ("public_advisory", "triage_rules", "teleconsultation", "pollution_care")])
    as_of = F.to_timestamp(F.lit("2025-12-04 08:00:00"))
    plans = assemble_plan(df, staffing, supplies, advisory, as_of)
    rows = {r["hospital_id"]: r["plan"] for r in plans.collect()}
    assert len(rows) == len(SAMPLES) and len({p["requestId"] for p in rows.values()}) == len(SAMPLES)
    assert rows[3]["monitorReport"]["alertLevel"] == "critical" and len(rows[3]["recommendedActions"]) == 4
    assert [e["agent"] for e in rows[0]["agentTrace"]] == ["prediction_api", "monitor", "staffing_planner", "supplies_planner", "advisory"]
    assert rows[0]["agentTrace"][1]["message"] == "Alert high"
    digest = {r["hospital"]: r for r in alert_digest(plans, as_of).collect()}
    assert digest["3"]["alert_level"] == "CRITICAL" and digest["3"]["inflow"] == "201.26"
    gap = alert_digest(plans.limit(1).withColumn("plan", F.lit(None).cast(plans.schema["plan"].dataType)), as_of).first()
    assert (gap["alert_level"], gap["inflow"], gap["hospital"]) == ("UNKNOWN", "N/A", "N/A")


def test_a_part_with_a_repeated_key_is_refused(spark):
    df = monitored(frame(spark)).withColumns({"date": F.lit("2025-12-05").cast("date"), "median": F.lit(1.0)})
    part = df.select("hospital_id", "date", F.lit(50).alias("doctors_needed"), F.lit(9).alias("nurses_needed"), F.lit(3).alias("support_staff_needed"))
    supplies = df.limit(0).select("hospital_id", "date", F.lit(7).alias("oxygen_cylinders"), F.lit(5).alias("beds"), F.array(F.lit("x")).alias("common_medicines"), F.array(F.lit("y")).alias("special_medicines"))
    advisory = df.limit(0).select("hospital_id", "date", *[F.lit(c).alias(c) for c in ("public_advisory", "triage_rules", "teleconsultation", "pollution_care")])
    as_of = F.to_timestamp(F.lit("2025-12-04 08:00:00"))
    whole = assemble_plan(df, part, supplies, advisory, as_of).collect()
    assert len(whole) == len(SAMPLES) and all(r["plan"]["staffingPlan"] and r["plan"]["suppliesPlan"] is None for r in whole)
    with pytest.raises(Exception, match="staffing has more than one row"):
        assemble_plan(df, part.unionByName(part), supplies, advisory, as_of).collect()
