"""Small numeric and array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def flag(condition: Column) -> Column:
    """1 where true, else 0 (also for null)."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def clamp01(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def present_items(*items: Column) -> Column:
    """Array of the non-null arguments, in order."""
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def known(value: Column) -> Column:
    """A number as a double; NaN counts as missing."""
    return F.nanvl(value.try_cast("double"), F.lit(None).cast("double"))


def number_or_zero(column: Column) -> Column:
    """Text or number to double; what cannot be read, and NaN, becomes 0."""
    return F.coalesce(known(column), F.lit(0.0))


def is_between(value: Column, low: Column, high: Column) -> Column:
    return F.when((value >= low) & (value <= high), F.lit(1.0)).otherwise(F.lit(0.0))


def round_half(value: Column, digits: int, mode: str = "up") -> Column:
    """Round half up, or half to even with ``mode='even'``."""
    return F.round(value, digits) if mode == "up" else F.bround(value, digits)


def sentence_case(text: Column) -> Column:
    """First letter upper, the rest lower."""
    rest = F.right(text, F.greatest(F.length(text) - 1, F.lit(0)))
    return F.concat(F.upper(F.left(text, F.lit(1))), F.lower(rest))


def fixed_point(value: Column, digits: int) -> Column:
    """Half-up decimal with exactly ``digits`` places.

    The nudge makes a double that reads 1.005 round up although it is stored slightly below.
    """
    scale = F.lit(float(10 ** digits))
    return (F.floor(value * scale + F.lit(0.5000001)) / scale).cast(f"decimal(18,{digits})")
