"""Forecast bands: corrections relative to a batch, widening, blending, ordering.

A batch is the whole table or the rows sharing ``batch`` columns (a request, a micro-batch).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardcast.fixed_values import (
    BLEND_WEIGHT, EXTREME_LARGE, EXTREME_SMALL, MODES, SMALL_BATCH, SPIKE_LARGE, SPIKE_SMALL,
    WIDEN_FACTOR, WIDEN_LEVEL, WIDEN_PERCENTILE,
)
from wardcast.functions.scalars import known
from wardcast.operators.quantiles import attach_by_batch, quantile_row
from wardcast.session import via_table

STEPS = {"spike": (SPIKE_LARGE, SPIKE_SMALL), "extreme": (EXTREME_LARGE, EXTREME_SMALL)}


def _multiplier(value: Column, stats: Column, large: list, small: list) -> Column:
    """Highest multiplier whose bound the value exceeds; bounds depend on the batch size."""
    by_share, by_level = F.lit(1.0), F.lit(1.0)
    for i, (_, times) in enumerate(large):
        by_share = F.when(value > stats["q"][i], F.lit(times)).otherwise(by_share)
    for level, times in small:
        by_level = F.when(value > F.lit(level), F.lit(times)).otherwise(by_level)
    return F.when(stats["n"] > SMALL_BATCH, by_share).otherwise(by_level)


def scale_corrections(df: DataFrame, columns: Sequence[str] = ("spike", "extreme"), batch: Sequence[str] = ()) -> DataFrame:
    """Add ``<column>_scaled``: corrections enlarged by their rank in the batch.

    All columns share one quantile pass.
    """
    probs = [p for p, _ in SPIKE_LARGE]
    stats = quantile_row(df, {c: F.col(c) for c in columns}, probs, batch)
    with_stats = attach_by_batch(df, stats, "__stats", batch)
    scaled = {
        f"{c}_scaled": F.col(c) * _multiplier(F.col(c), F.col("__stats")[c], *STEPS[c]) for c in columns
    }
    return with_stats.withColumns(scaled).drop("__stats")


def apply_adjustment(df: DataFrame, parts: Sequence[str] = ("spike_scaled", "extreme_scaled")) -> DataFrame:
    """Add the total correction to all three quantiles."""
    total = F.lit(0.0)
    for p in parts:
        total = total + F.coalesce(F.col(p), F.lit(0.0))
    moved = df.withColumn("adjustment", total)
    return moved.withColumns({c: F.col(c) + F.col("adjustment") for c in ("q10", "q50", "q90")})


def any_adjustment(df: DataFrame, column: str = "adjustment", batch: Sequence[str] = ()) -> DataFrame:
    """Whether any row of the batch has a nonzero correction."""
    return df.groupBy(*batch).agg(F.bool_or(F.col(column) != 0).alias("adjusted"))


def mark_extremes(df: DataFrame, batch: Sequence[str] = ()) -> DataFrame:
    """Add ``is_high``: the highest medians of an adjusted batch."""
    moved = F.when(F.col("adjustment") != 0, F.lit(1.0))
    stats = quantile_row(df, {"q50": F.col("q50"), "moved": moved}, [WIDEN_PERCENTILE], batch)
    with_stats = attach_by_batch(df, stats, "__stats", batch)
    median, moved_rows = F.col("__stats")["q50"], F.col("__stats")["moved"]["n"]
    high = F.when(median["n"] > SMALL_BATCH, F.col("q50") > median["q"][0]).otherwise(F.col("q50") > WIDEN_LEVEL)
    return with_stats.withColumn("is_high", (moved_rows > 0) & high).drop("__stats")


def widened(df: DataFrame) -> DataFrame:
    """Widen the band of marked rows by half around its centre."""
    centre, width = (F.col("q90") + F.col("q10")) / 2, F.col("q90") - F.col("q10")
    return df.withColumns({
        "q10": F.when(F.col("is_high"), centre - width * WIDEN_FACTOR).otherwise(F.col("q10")),
        "q90": F.when(F.col("is_high"), centre + width * WIDEN_FACTOR).otherwise(F.col("q90")),
    }).drop("is_high")


def widen_extreme_band(df: DataFrame, batch: Sequence[str] = ()) -> DataFrame:
    """Widen the band by half around its centre for the highest medians of an adjusted batch."""
    return widened(mark_extremes(df, batch))


def widen_fixed(df: DataFrame, margin: float = 0.5) -> DataFrame:
    return df.withColumns({"q10": F.col("q10") - margin, "q90": F.col("q90") + margin})


def blend_median(df: DataFrame, second: str = "second", weight: float | Column = BLEND_WEIGHT) -> DataFrame:
    """``median`` = weight on the second model, the rest on the first."""
    w = F.lit(float(weight)) if isinstance(weight, (int, float)) else weight
    return df.withColumn("median", w * F.col(second) + (F.lit(1.0) - w) * F.col("q50"))


def order_bands_ensemble(df: DataFrame) -> DataFrame:
    low, median, high = (known(F.col(c)) for c in ("q10", "median", "q90"))  # NaN does not win a comparison
    lower = F.least(low - 1.5, median - 2.0)
    upper = F.greatest(high + 1.5, median + 2.0)
    return df.withColumns({"lower": lower, "upper": F.greatest(upper, lower + 0.1)})


def order_bands(df: DataFrame, margin: float = 1e-6) -> DataFrame:
    """Keep the band at least ``margin`` away from the median (1e-6 single model, 1.0 older blend)."""
    low, median, high = (known(F.col(c)) for c in ("q10", "median", "q90"))
    return df.withColumns({"lower": F.least(low, median - margin), "upper": F.greatest(high, median + margin)})


def order_bands_train(df: DataFrame) -> DataFrame:
    return df.withColumn("q10", F.least(known(F.col("q10")), known(F.col("q90")) - 1e-6))


def no_second_model(df: DataFrame) -> DataFrame:
    """Without a second model the corrected quantiles are the forecast, unordered."""
    return df.withColumns({"lower": F.col("q10"), "median": F.col("q50"), "upper": F.col("q90")})


def corrected(df: DataFrame, batch: Sequence[str] = ()) -> DataFrame:
    """Corrections, adjustment and widening in a row.

    The second step's statistics read the result of the first, so with many batches that
    result is written once instead of being joined together for every pass.
    """
    adjusted = apply_adjustment(scale_corrections(df, batch=batch))
    return widen_extreme_band(via_table(adjusted, "adjusted") if batch else adjusted, batch)


def combine_models(*parts: DataFrame, keys: Sequence[str] = ("hospital_id", "date")) -> DataFrame:
    """Put separately scored model outputs side by side by key.

    Every row of the first part stays; what another part does not have is null.
    """
    first, *others = parts
    for other in others:
        first = first.join(other, list(keys), "left")
    return first


def score_modes(df: DataFrame, modes: Sequence[str] = tuple(MODES), batch: Sequence[str] = ()) -> DataFrame:
    """``score_mode`` of several modes below each other, with a ``mode`` column.

    The corrections and the widening threshold do not depend on the mode: a mode's margin moves q10 and q90 alone, and
    widening is linear in them. So the statistics are computed once, and each mode is a projection.
    """
    rows = df.withColumns({"__low": F.col("q10"), "__high": F.col("q90")})
    adjusted = apply_adjustment(scale_corrections(rows, batch=batch))
    done = via_table(mark_extremes(via_table(adjusted, "adjusted") if batch else adjusted, batch), "corrected")
    out = None
    for mode in modes:
        margin = 0.0 if mode == "ensemble" else 0.5
        one = widened(done.withColumns({"q10": F.col("__low") - margin + F.col("adjustment"), "q90": F.col("__high") + margin + F.col("adjustment")}))
        one = _ordered(one.drop("__low", "__high"), mode).withColumn("mode", F.lit(mode))
        out = one if out is None else out.unionByName(one)
    return out


def score_mode(
    df: DataFrame, mode: str = "ensemble", weight: float | Column = BLEND_WEIGHT, batch: Sequence[str] = ()
) -> DataFrame:
    """Forecast band for a mode from raw model outputs ``q10 q50 q90 spike extreme [second]``."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    return _ordered(corrected(df if mode == "ensemble" else widen_fixed(df), batch), mode, weight)


def _ordered(done: DataFrame, mode: str, weight: float | Column = BLEND_WEIGHT) -> DataFrame:
    """Blend and order corrected quantiles. The weight is the ensemble's; ``tft`` always blends with the fixed one."""
    if mode == "ensemble":
        return order_bands_ensemble(blend_median(done, weight=weight)) if "second" in done.columns else no_second_model(done)
    banded = order_bands(done.withColumn("median", F.col("q50")))
    return blend_median(banded) if mode == "tft" else banded
