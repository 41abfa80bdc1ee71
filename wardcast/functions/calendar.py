"""Calendar expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_index(day: Column) -> Column:
    """Proleptic day number: 1 on 0001-01-01."""
    return F.datediff(day, F.to_date(F.lit("0001-01-01"))) + 1


def season_of(month: Column, first: int) -> Column:
    """Quarter of the year counted from December, starting at ``first``."""
    return (F.floor(F.pmod(month, F.lit(12)) / 3) + first).cast("int")


def wave(position: Column, period: float, kind: str = "sin", amplitude: float = 1.0, phase: float = 0.0) -> Column:
    """One sine or cosine term with the given period."""
    angle = F.lit(2 * math.pi) * position / F.lit(float(period)) + F.lit(float(phase))
    return F.lit(float(amplitude)) * (F.sin(angle) if kind == "sin" else F.cos(angle))


def yearly_wave(day: Column, amplitude: float = 1.0, phase: float = 0.0) -> Column:
    """Seasonal term over the day of the year, period 365."""
    return wave(F.dayofyear(day).cast("double"), 365.0, "sin", amplitude, phase)


def periodic_mark(day: Column) -> Column:
    """1.0 on every 111th day number, 0.4 on every 37th, else 0."""
    n = day_index(day)
    return (
        F.when(F.pmod(n, F.lit(111)) == 0, F.lit(1.0))
        .when(F.pmod(n, F.lit(37)) == 0, F.lit(0.4))
        .otherwise(F.lit(0.0))
    )


def weekday_of(day: Column) -> Column:
    """Monday is 0."""
    return F.weekday(day)
