"""Per-entity time windows.

A panel has one row per entity and day, so the largest window partition is the number of
days the data spans (about 36,500 rows for a century) however large the table is. Reduce raw
records with ``daily_rollup`` or ``dedup_keep_first`` first. All operators share one window
specification, so Spark sorts once for any combination of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardcast.fixed_values import DEFAULT_ADMISSIONS
from wardcast.functions.fixed import fixed_row
from wardcast.functions.scalars import round_half


def series(entity: str | Sequence[str] = "hospital_id", time: str | Sequence[str] = "date") -> WindowSpec:
    keys = [entity] if isinstance(entity, str) else list(entity)
    return W.partitionBy(*keys).orderBy(*([time] if isinstance(time, str) else time))


def lag_or_first(value: Column, k: int, w: WindowSpec) -> Column:
    """Value ``k`` rows back; before that, the first value of the entity."""
    return F.coalesce(F.lag(value, k).over(w), F.first(value).over(w))


def rolling_mean(value: Column, rows: int, w: WindowSpec, strict: bool = False) -> Column:
    """Mean of the last ``rows`` rows, ending at this row, or before it when ``strict``."""
    frame = w.rowsBetween(-rows, -1) if strict else w.rowsBetween(1 - rows, 0)
    return F.avg(value).over(frame)


def lag_features(
    df: DataFrame,
    target: str = "admissions",
    entity: str | Sequence[str] = "hospital_id",
    time: str = "date",
    rounding: str = "up",
) -> DataFrame:
    """Add lag 1, lag 7 and the 14-row rolling mean of the target (two decimals)."""
    w = series(entity, time)
    y = F.col(target)
    return df.withColumns({
        f"lag_1_{target}": lag_or_first(y, 1, w),
        f"lag_7_{target}": lag_or_first(y, 7, w),
        f"rolling_14_{target}": round_half(rolling_mean(y, 14, w), 2, rounding),
    })


def serving_lags(
    df: DataFrame, target: str = "admissions", entity: str | Sequence[str] = "hospital_id", time: str | Sequence[str] = "date"
) -> DataFrame:
    """Lags for requests that come without them; a constant level when there is no target.

    For several requests at once, ``entity`` is (request, hospital) and ``time`` (date, position): each request is a
    series of its own, and the many requests without a hospital do not meet in one window.
    """
    names = [f"lag_1_{target}", f"lag_7_{target}", f"rolling_14_{target}"]
    if names[0] in df.columns:
        return df
    if target not in df.columns:
        return df.withColumns({n: F.lit(float(DEFAULT_ADMISSIONS)) for n in names})
    w = series(entity, time)
    y = F.col(target).cast("double")
    first = F.first(y).over(w)
    return df.withColumns({
        names[0]: F.coalesce(F.lag(y, 1).over(w), first),
        names[1]: F.coalesce(F.lag(y, 7).over(w), first),
        names[2]: F.coalesce(rolling_mean(y, 14, w), first),
    })


def lag_exogenous(df: DataFrame, entity: str = "hospital_id", time: str = "date") -> DataFrame:
    """Stand-ins for the lag interactions from air quality and outbreak history."""
    w = series(entity, time)
    return df.withColumns({
        "lag1_aqi": lag_or_first(F.col("aqi"), 1, w),
        "lag7_outbreak": lag_or_first(F.col("outbreak_index"), 7, w),
        "rolling_aqi": rolling_mean(F.col("aqi"), 14, w),
    })


def exogenous_identity(df: DataFrame) -> DataFrame:
    """Stand-ins for the lag interactions when there is no entity: today's values."""
    return df.withColumns({
        "lag1_aqi": F.col("aqi"), "lag7_outbreak": F.col("outbreak_index"), "rolling_aqi": F.col("aqi"),
    })


def lead_covariates(
    df: DataFrame,
    columns: Sequence[str] = ("aqi", "temp", "rainfall"),
    horizons: int = 7,
    nested: bool = False,
    entity: str = "hospital_id",
    time: str = "date",
) -> DataFrame:
    """Values exactly 1..``horizons`` days ahead, null where that day has no row.

    The frame is a range over the day number, so gaps need no densified calendar.
    ``nested`` gives one array of structs instead of wide columns.
    """
    day = F.datediff(F.col(time), F.to_date(F.lit("1970-01-01")))
    keys = [entity] if isinstance(entity, str) else list(entity)
    w = W.partitionBy(*keys).orderBy(day)
    ahead = {(c, h): F.max(c).over(w.rangeBetween(h, h)) for c in columns for h in range(1, horizons + 1)}
    if nested:
        steps = [F.struct(*[ahead[c, h].alias(c) for c in columns]) for h in range(1, horizons + 1)]
        return df.withColumn("forecast", F.array(*steps))
    return df.withColumns({f"{c}_forecast_{h}": v for (c, h), v in ahead.items()})


def time_index(df: DataFrame, time: str = "date") -> DataFrame:
    """Days since the first day of the table."""
    start = fixed_row(df.agg(F.min(time).alias("start")))["start"]
    return df.withColumn("time_idx", F.datediff(F.col(time), start))


def fill_forward_back_zero(
    df: DataFrame, columns: Sequence[str], entity: str | Sequence[str] = "hospital_id", time: str = "date"
) -> DataFrame:
    """Fill gaps from the past, then the future of the same entity, then with 0; NaN is a gap."""
    keys = [entity] if isinstance(entity, str) else list(entity)
    past = series(entity, time).rowsBetween(W.unboundedPreceding, 0)
    # the future as the past of the reversed series: a frame that grows row by row is linear,
    # one that shrinks towards the end is recomputed for every row
    future = W.partitionBy(*keys).orderBy(F.desc(time)).rowsBetween(W.unboundedPreceding, 0)
    numbers = {c: F.nanvl(c, F.lit(None).cast(df.schema[c].dataType)) for c in columns if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))}
    df = df.withColumns(numbers) if numbers else df
    return df.withColumns({
        c: F.coalesce(F.last(c, True).over(past), F.last(c, True).over(future), F.lit(0).cast(df.schema[c].dataType))
        for c in columns
    })
