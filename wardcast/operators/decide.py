"""From a forecast row to an alert and an operational plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardcast import fixed_values as V
from wardcast.functions.scalars import clamp01, fixed_point, present_items


def weather_risk(rainfall: Column, temp: Column, humidity: Column) -> Column:
    """Rain, heat and humidity as one score in [0, 1]; a missing input counts as 0."""
    rain, heat, damp = (F.coalesce(c.cast("double"), F.lit(0.0)) for c in (rainfall, temp, humidity))
    return clamp01(rain / 60.0 + F.greatest(heat - 35.0, F.lit(0.0)) / 25.0 + (damp - 70.0) / 40.0)


def monitor_inputs(df: DataFrame, sensitivity: Column | None = None) -> DataFrame:
    """Add the four scores the alert rule reads."""
    level = F.lit(V.DEFAULT_SENSITIVITY) if sensitivity is None else F.coalesce(sensitivity, F.lit(V.DEFAULT_SENSITIVITY))
    return df.withColumns({
        "aqi_score": F.coalesce(F.col("aqi").cast("double"), F.lit(V.DEFAULT_AQI)),
        "festival_score": clamp01(F.coalesce(F.col("festival_flag").cast("double"), F.lit(0.0))),
        "weather_score": weather_risk(F.col("rainfall"), F.col("temp"), F.col("humidity")),
        "sensitivity_score": clamp01(level.cast("double")),
    })


def _by_air(aqi: Column, labels: Sequence[str], lifted: Column) -> Column:
    low, moderate, high, critical = labels
    return (
        F.when(aqi >= 300, F.lit(critical)).when(aqi >= 200, F.lit(high)).when(aqi >= 150, F.lit(moderate))
        .when(lifted, F.lit(moderate)).otherwise(F.lit(low))
    )


def risk_alert(df: DataFrame) -> DataFrame:
    """Add ``alert_level`` and ``urgency``: air quality first, lifted by festivals or weather."""
    lifted = (F.col("festival_score") > 0.6) | (F.col("weather_score") > 0.6)
    return df.withColumns({
        "alert_level": _by_air(F.col("aqi_score"), V.ALERT_LEVELS, lifted),
        "urgency": _by_air(F.col("aqi_score"), V.URGENCIES, lifted),
    })


def risk_factors(df: DataFrame) -> DataFrame:
    """Add ``risk_factors``: the reasons in order, or a single default."""
    aqi = F.col("aqi_score")
    air = F.when(aqi >= 300, F.lit(V.FACTOR_HAZARDOUS)).when(aqi >= 200, F.lit(V.FACTOR_VERY_UNHEALTHY)).when(
        aqi >= 150, F.lit(V.FACTOR_UNHEALTHY))
    found = present_items(
        air,
        F.when(F.col("festival_score") > 0.6, F.lit(V.FACTOR_FESTIVAL)),
        F.when(F.col("weather_score") > 0.6, F.lit(V.FACTOR_WEATHER)),
    )
    return df.withColumn("risk_factors", F.when(F.size(found) == 0, F.array(F.lit(V.FACTOR_NONE))).otherwise(found))


def monitored(df: DataFrame, sensitivity: Column | None = None) -> DataFrame:
    return risk_factors(risk_alert(monitor_inputs(df, sensitivity)))


def recommended_actions(
    alert: str = "alert_level", urgency: str = "urgency", cylinders: str = "oxygen_cylinders", doctors: str = "doctors_needed"
) -> Column:
    return present_items(
        F.format_string(V.ACTION_NOTIFY, F.col(alert)),
        F.format_string(V.ACTION_OXYGEN, F.col(cylinders)),
        F.when(F.col(urgency).isin(V.URGENCIES[2:]), F.lit(V.ACTION_SURGE)),
        F.when(F.col(doctors) > V.LOCUM_DOCTORS, F.lit(V.ACTION_LOCUM)),
    )


def plan_trace(as_of: Column, alert: str = "alert_level") -> Column:
    """Ordered audit entries of how a plan came about."""
    entries = []
    for agent, message in V.TRACE_STEPS:
        text = F.format_string(message, F.col(alert)) if "%s" in message else F.lit(message)
        entries.append(F.struct(F.lit(agent).alias("agent"), text.alias("message"), as_of.alias("timestamp")))
    return F.array(*entries)


def request_id(*keys: str) -> Column:
    """Reproducible plan id."""
    return F.sha2(F.concat_ws("/", *[F.col(k).cast("string") for k in keys]), 256)


def assemble_plan(
    df: DataFrame,
    staffing: DataFrame,
    supplies: DataFrame,
    advisory: DataFrame,
    as_of: Column,
    keys: Sequence[str] = ("hospital_id", "date"),
    inflow: str = "median",
) -> DataFrame:
    """One nested ``plan`` per forecast row.

    ``df`` is a monitored forecast; the three other tables carry the written plans by key, the entity being the last key but one. A row keeps its plan when a part is
    missing: that part is null. A part with a repeated key is refused when the plans are computed, since it would multiply them.
    """
    entity = keys[-2]
    joined, names = df, ("staffing", "supplies", "advisory")
    for name, part in zip(names, (staffing, supplies, advisory)):
        cells = [c for c in part.columns if c not in keys]
        once = part.groupBy(*keys).agg(F.any_value(F.struct(*cells)).alias("cells"), F.count("*").alias("n"))
        repeated = F.raise_error(F.lit(f"{name} has more than one row for a key of {list(keys)}"))
        whole = F.when(F.col("n") > 1, repeated.cast(once.schema["cells"].dataType)).otherwise(F.col("cells"))
        joined = joined.join(once.select(*keys, whole.alias(f"__{name}")), list(keys), "left")
        joined = joined.withColumns({c: F.col(f"__{name}.{c}") for c in cells}).withColumn(f"__{name}", F.col(f"__{name}").isNotNull())

    def given(name: str, *cells: Column) -> Column:
        return F.when(F.col(f"__{name}"), F.struct(*cells))

    plan = F.struct(
        request_id(*keys).alias("requestId"),
        as_of.alias("timestamp"),
        F.coalesce(F.col(entity).cast("string"), F.lit(V.DEFAULT_HOSPITAL)).alias("hospitalId"),
        F.col(inflow).cast("double").alias("predictedInflow"),
        F.struct(
            F.col("alert_level").alias("alertLevel"), F.col("risk_factors").alias("riskFactors"),
            F.col("urgency").alias("recommendedUrgency"),
        ).alias("monitorReport"),
        given(
            "staffing", F.col("doctors_needed").alias("doctorsNeeded"), F.col("nurses_needed").alias("nursesNeeded"),
            F.col("support_staff_needed").alias("supportStaffNeeded"),
        ).alias("staffingPlan"),
        given(
            "supplies", F.col("oxygen_cylinders").alias("oxygenCylinders"), F.col("beds").alias("beds"),
            F.col("common_medicines").alias("commonMedicines"), F.col("special_medicines").alias("specialMedicines"),
        ).alias("suppliesPlan"),
        given(
            "advisory", F.col("public_advisory").alias("publicAdvisory"), F.col("triage_rules").alias("triageRules"),
            F.col("teleconsultation").alias("teleconsultation"), F.col("pollution_care").alias("pollutionCare"),
        ).alias("advisory"),
        recommended_actions().alias("recommendedActions"),
        plan_trace(as_of).alias("agentTrace"),
    )
    return joined.select(*keys, plan.alias("plan"))


def plan_gaps(plans: DataFrame) -> DataFrame:
    """One row: plans, and how many lack each part."""
    p = F.col("plan")
    return plans.agg(F.count("*").alias("plans"), *[
        F.count_if(p[part].isNull()).alias(name) for part, name in (("staffingPlan", "no_staffing"), ("suppliesPlan", "no_supplies"), ("advisory", "no_advisory"))])


def alert_rollup(df: DataFrame, by: Sequence[str] = ("date",), level: str = "alert_level") -> DataFrame:
    """Plans per alert level and day."""
    return df.groupBy(*by, level).agg(F.count("*").alias("plans"))


def alert_digest(df: DataFrame, as_of: Column) -> DataFrame:
    """Message fields of a finished plan, with defaults for what is missing."""
    none = F.lit("N/A")
    return df.select(
        F.format_string("Operational plan - %s", F.coalesce(F.col("plan.hospitalId"), none)).alias("title"),
        F.upper(F.coalesce(F.col("plan.monitorReport.alertLevel"), F.lit("unknown"))).alias("alert_level"),
        F.coalesce(fixed_point(F.col("plan.predictedInflow"), 2).cast("string"), none).alias("inflow"),
        F.coalesce(F.col("plan.hospitalId"), none).alias("hospital"),
        F.date_format(as_of, "yyyy-MM-dd HH:mm:ss").alias("time"),
    )
