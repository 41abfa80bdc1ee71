"""Prompts from columns, and structured answers back from text."""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardcast.fixed_values import ALERT_LEVELS, NOISE_TOKEN, URGENCIES
from wardcast.functions.scalars import fixed_point

MONITOR_SCHEMA = "alertLevel string, riskFactors array<string>, recommendedUrgency string"

TEMPLATES = {
    "monitor": (
        "Judge today's load risks of a hospital from the scores below.\n"
        "AQI: {aqi}\nFestival score (0-1): {festival_score}\nWeather risk (0-1): {weather_risk}\n"
        "Disease sensitivity (0-1): {disease_sensitivity}\n"
        "Answer with one JSON object with the keys alertLevel, riskFactors and recommendedUrgency."
    ),
    "staffing": (
        "Plan the staff of a large city hospital for {predicted_inflow} expected patients; add a buffer above 250.\n"
        "Answer with one JSON object with the integer keys doctorsNeeded, nursesNeeded and supportStaffNeeded."
    ),
    "supplies": (
        "Plan the consumables of a hospital for {predicted_inflow} expected patients.\n"
        "Answer with one JSON object with the keys oxygenCylinders, beds, commonMedicines and specialMedicines."
    ),
    "advisory": (
        "Write short guidance for a hospital command centre.\n"
        "Expected patients: {predicted_inflow}\nAlert level: {alert_level}\nRisk factors: {risk_factors}\n"
        "Answer with one JSON object with the keys publicAdvisory, triageRules, teleconsultation and pollutionCare."
    ),
}


def render_template(template: str, fields: dict[str, Column]) -> Column:
    """Fill ``{name}`` places of a template with columns."""
    parts: list[Column] = []
    for text, name, _, _ in string.Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if name is not None:
            parts.append(fields[name].cast("string"))
    return F.concat(*parts)


def render_prompts(df: DataFrame, inflow: str = "median", templates: dict[str, str] | None = None) -> DataFrame:
    """Add ``<name>_prompt`` per template to a monitored forecast."""
    templates = TEMPLATES if templates is None else templates
    fields = {
        "aqi": fixed_point(F.col("aqi_score"), 2),
        "festival_score": fixed_point(F.col("festival_score"), 2),
        "weather_risk": fixed_point(F.col("weather_score"), 2),
        "disease_sensitivity": fixed_point(F.col("sensitivity_score"), 2),
        "predicted_inflow": fixed_point(F.col(inflow), 1),
        "alert_level": F.col("alert_level"),
        "risk_factors": F.concat_ws(", ", "risk_factors"),
    }
    return df.withColumns({f"{n}_prompt": render_template(t, fields) for n, t in templates.items()})


def extract_json_block(text: Column) -> Column:
    """The outermost braces of the first fenced block, or of the whole text; null without any."""
    inside = F.regexp_extract(text, "(?is)```(?:json)?(.*?)```", 1)
    candidate = F.when(text.rlike("(?is)```(?:json)?(.*?)```"), inside).otherwise(text)
    block = F.regexp_extract(candidate, r"(?s)\{.*\}", 0)
    straight = F.translate(F.replace(block, F.lit(NOISE_TOKEN), F.lit("")), "“”", '""')
    return F.nullif(F.trim(straight), F.lit(""))


def parse_structured(
    df: DataFrame, text: str, schema: str = MONITOR_SCHEMA, required: Sequence[str] = ("alertLevel", "riskFactors", "recommendedUrgency")
) -> DataFrame:
    """Add ``parsed`` (null on failure) and ``parse_status`` (raw, repaired, failed)."""
    def complete(parsed: str) -> Column:
        ok = F.lit(True)
        for field in required:
            ok = ok & F.col(parsed)[field].isNotNull()
        return ok

    # each text is parsed once, and searched for a block only when it is not JSON itself
    first = df.withColumn("__raw", F.from_json(F.col(text), schema)).withColumn("__ok", complete("__raw"))
    block = F.when(~F.col("__ok"), extract_json_block(F.col(text)))
    second = first.withColumn("__block", block).withColumn("__fixed", F.from_json("__block", schema))
    return second.withColumns({
        "parsed": F.when(F.col("__ok"), F.col("__raw")).when(complete("__fixed"), F.col("__fixed")),
        "parse_status": F.when(F.col("__ok"), F.lit("raw")).when(complete("__fixed"), F.lit("repaired")).otherwise(F.lit("failed")),
    }).drop("__raw", "__ok", "__block", "__fixed")


def parse_or_rule(df: DataFrame, text: str) -> DataFrame:
    """Take the written answer where it parses and uses known labels, else the rule's result."""
    answered = parse_structured(df, text)
    known = F.col("parsed.alertLevel").isin(ALERT_LEVELS) & F.col("parsed.recommendedUrgency").isin(URGENCIES)
    use = F.coalesce(known, F.lit(False))
    return answered.withColumns({
        "alert_level": F.when(use, F.col("parsed.alertLevel")).otherwise(F.col("alert_level")),
        "urgency": F.when(use, F.col("parsed.recommendedUrgency")).otherwise(F.col("urgency")),
        "risk_factors": F.when(use, F.col("parsed.riskFactors")).otherwise(F.col("risk_factors")),
        "decided_by": F.when(use, F.lit("answer")).otherwise(F.lit("rule")),
    }).drop("parsed")
