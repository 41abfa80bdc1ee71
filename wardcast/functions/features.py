"""Column expressions of the two feature profiles.

The profiles share names but not formulas: ``train`` is what models are fitted on, ``serve``
is what requests are scored with.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardcast.fixed_values import AIR_CLASS_EDGES
from wardcast.functions.calendar import season_of, wave
from wardcast.functions.scalars import flag

YEAR_LENGTH = {"train": 365.25, "serve": 365.0}


def calendar_columns(day: Column, profile: str) -> dict[str, Column]:
    month = F.month(day)
    position = F.dayofyear(day).cast("double")
    year = YEAR_LENGTH[profile]
    return {
        "month": month,
        "week_of_year": F.weekofyear(day),
        "quarter": F.quarter(day),
        "season": season_of(month, 1 if profile == "train" else 0),
        "day_sin": wave(position, year, "sin"),
        "day_cos": wave(position, year, "cos"),
        "month_sin": wave(month.cast("double"), 12.0, "sin"),
        "month_cos": wave(month.cast("double"), 12.0, "cos"),
    }


def air_flags(aqi: Column) -> dict[str, Column]:
    return {f"aqi_above_{level}": flag(aqi > level) for level in (150, 200, 300)}


def air_class(aqi: Column) -> Column:
    """Right-closed classes; null outside the range instead of an error."""
    classes = F.when((aqi < 0) | (aqi > AIR_CLASS_EDGES[-1]), F.lit(None).cast("int"))
    for number, edge in enumerate(AIR_CLASS_EDGES):
        classes = classes.when(aqi <= edge, F.lit(number))
    return classes


def air_score(aqi: Column) -> Column:
    """Weighted sum of the threshold flags."""
    f = air_flags(aqi)
    return (
        F.lit(0.5) * f["aqi_above_150"] + F.lit(1.0) * f["aqi_above_200"] + F.lit(1.5) * f["aqi_above_300"]
    )


def air_columns(aqi: Column, profile: str) -> dict[str, Column]:
    return air_flags(aqi) | {"aqi_severity": air_class(aqi) if profile == "train" else air_score(aqi)}


def interaction_columns(profile: str, respiratory: Column | None = None) -> dict[str, Column]:
    aqi, temp, rain = F.col("aqi"), F.col("temp"), F.col("rainfall")
    mobility, outbreak = F.col("mobility_index"), F.col("outbreak_index")
    both = {
        "temp_humidity": temp * F.col("humidity"),
        "aqi_temp": aqi * temp,
        "mobility_outbreak": mobility * (1 + outbreak),
        "temp_rainfall": temp * rain,
    }
    if profile == "train":
        own = {
            "rainfall_injury_risk": rain * F.when(rain > 20, F.lit(1.5)).otherwise(F.lit(1.0)),
            "aqi_respiratory_ratio": aqi * F.when(aqi > 100, F.lit(1.3)).otherwise(F.lit(1.0)),
            "rainfall_weekend": rain * F.col("is_weekend"),
            "aqi_mobility": aqi * (100 - mobility) / 100,
        }
    else:
        cases = F.lit(0.0) if respiratory is None else respiratory
        own = {
            "rainfall_injury_risk": rain * F.col("is_weekend"),
            "aqi_respiratory_ratio": F.try_divide(aqi, cases + 1),
            "aqi_mobility": aqi * mobility,
        }
    return both | own


def lag_interactions(profile: str) -> dict[str, Column]:
    """Interactions of admission lags with the environment."""
    share = F.col("aqi") / 100
    outbreak = F.col("outbreak_index") if profile == "train" else F.col("outbreak_index") / 100
    return {
        "lag1_aqi": F.col("lag_1_admissions") * share,
        "lag7_outbreak": F.col("lag_7_admissions") * (1 + outbreak),
        "rolling_aqi": F.col("rolling_14_admissions") * share,
    }
