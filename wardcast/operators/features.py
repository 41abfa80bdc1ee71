"""Feature tables for both profiles, scaling and reports over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardcast.fixed_values import FEATURES, RISING_FEATURES, UNSCALED_FEATURES
from wardcast.functions.fixed import fixed_row
from wardcast.functions.features import air_columns, calendar_columns, interaction_columns, lag_interactions
from wardcast.functions.scalars import known, number_or_zero
from wardcast.operators.clean import add_missing_as_zero, require_columns
from wardcast.operators.windows import exogenous_identity, fill_forward_back_zero, lag_exogenous
from wardcast.session import drop_table, via_table

LAGS = ("lag_1_admissions", "lag_7_admissions", "rolling_14_admissions")


def features(df: DataFrame, profile: str = "train", entity: str = "hospital_id", time: str = "date") -> DataFrame:
    """Add all engineered columns of a profile; one projection unless lags must be derived."""
    if profile not in ("train", "serve"):
        raise ValueError("profile must be 'train' or 'serve'")
    require_columns(df, [time, "aqi"])
    cases = F.col("respiratory") if "respiratory" in df.columns else None
    columns = (
        calendar_columns(F.col(time), profile)
        | air_columns(F.col("aqi"), profile)
        | interaction_columns(profile, cases)
    )
    if all(c in df.columns for c in LAGS):
        return df.withColumns(columns | lag_interactions(profile))
    if profile == "train":
        return df.withColumns(columns)
    lagged = lag_exogenous(df, entity, time) if entity in df.columns else exogenous_identity(df)
    return lagged.withColumns(columns)


def feature_matrix(
    df: DataFrame,
    profile: str = "train",
    keys: Sequence[str] = ("hospital_id", "date"),
    keep: Sequence[str] = (),
    entity: str = "hospital_id",
    time: str = "date",
    fill_gaps: bool = False,
) -> DataFrame:
    """Keys, then the 41 model inputs as floats in their fixed order.

    Absent, unreadable, NaN and null inputs are 0; with ``fill_gaps`` nulls first take the entity's
    last known value, or else its next one, and the result is a stored table (``filled_matrix``); without gaps, nothing is sorted.
    """
    if fill_gaps:
        return filled_matrix(df, profile, keep, keys, entity, time)
    return _inputs(features(df, profile, entity, time), [*keys, *keep])


def filled_matrix(
    df: DataFrame,
    profile: str = "train",
    keep: Sequence[str] = (),
    keys: Sequence[str] = ("hospital_id", "date"),
    entity: str = "hospital_id",
    time: str = "date",
    partition_by: Sequence[str] = (),
) -> DataFrame:
    """``feature_matrix`` with its gaps filled, as a stored table.

    Gaps are counted while the table is written; only if there are any, it is written again with these columns filled.
    """
    full = features(df, profile, entity, time)
    present = [c for c in FEATURES if c in full.columns]
    full = full.select(*dict.fromkeys([*keys, *keep, *[k for k in (entity, time) if k in full.columns], *present]))
    gaps = Observation()
    table = via_table(_inputs(full.observe(gaps, *[F.count_if(known(F.col(c)).isNull()).alias(c) for c in present]), [*keys, *keep]), "features", partition_by)
    holes = [c for c in present if gaps.get[c]]
    if not holes:
        return table
    drop_table(table)
    return via_table(_inputs(fill_forward_back_zero(full, holes, entity, time), [*keys, *keep]), "features", partition_by)


def _inputs(full: DataFrame, lead: Sequence[str]) -> DataFrame:
    inputs = [number_or_zero(F.col(c)).cast("float").alias(c) for c in FEATURES]
    return add_missing_as_zero(full, FEATURES).select(*lead, *inputs)


def scale_features(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Standardise continuous columns with the population deviation; constants are centred only."""
    columns = [c for c in FEATURES if c in df.columns and c not in UNSCALED_FEATURES] if columns is None else list(columns)
    moments = fixed_row(df.agg(*[
        F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")).alias(c) for c in columns
    ]))
    scaled = {}
    for c in columns:
        std = F.col("__m")[c]["std"]
        scaled[c] = (F.col(c) - F.col("__m")[c]["mean"]) / F.when(std == 0, F.lit(1.0)).otherwise(std)
    return df.withColumn("__m", moments).withColumns(scaled).drop("__m")


def feature_skew(df: DataFrame, entity: str = "hospital_id", time: str = "date") -> DataFrame:
    """Per feature: rows where the two profiles differ and the largest absolute difference.

    Both profiles are computed side by side in one pass; nothing is joined.
    """
    train = {c: v.cast("double") for c, v in _profile_columns(df, "train", time).items()}
    serve = {c: v.cast("double") for c, v in _profile_columns(df, "serve", time).items()}
    gaps = [
        F.struct(F.lit(c).alias("feature"), F.abs(F.coalesce(train[c], F.lit(0.0)) - F.coalesce(serve[c], F.lit(0.0))).alias("gap"))
        for c in FEATURES if c in train and c in serve
    ]
    return (
        df.select(F.inline(F.array(*gaps)))
        .groupBy("feature")
        .agg(F.count_if(F.col("gap") > 1e-9).alias("rows_differing"), F.max("gap").alias("largest_gap"))
    )


def _profile_columns(df: DataFrame, profile: str, time: str) -> dict[str, Column]:
    return (
        calendar_columns(F.col(time), profile)
        | air_columns(F.col("aqi"), profile)
        | interaction_columns(profile, F.col("respiratory") if "respiratory" in df.columns else None)
        | lag_interactions(profile)
    )


def monotone_report(
    df: DataFrame, prediction: str, columns: Sequence[str] = tuple(RISING_FEATURES), buckets: int = 10
) -> DataFrame:
    """Average prediction per equal-width bucket of each feature that should only raise it.

    ``falls`` is 1 where the average drops against the bucket below.
    """
    span = fixed_row(df.agg(*[
        F.struct(F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi")).alias(c) for c in columns
    ]))
    entries = []
    for c in columns:
        lo, hi = F.col("__s")[c]["lo"], F.col("__s")[c]["hi"]
        place = F.floor(F.try_divide(F.col(c) - lo, hi - lo) * F.lit(float(buckets)))
        entries.append(F.struct(F.lit(c).alias("feature"), F.coalesce(F.least(place, F.lit(buckets - 1)), F.lit(0)).alias("bucket")))
    averages = (
        df.withColumn("__s", span)
        .select(F.col(prediction).alias("p"), F.inline(F.array(*entries)))
        .groupBy("feature", "bucket")
        .agg(F.count("*").alias("n_rows"), F.avg("p").alias("mean_prediction"))
    )
    below = F.lag("mean_prediction").over(W.partitionBy("feature").orderBy("bucket"))
    return averages.withColumn("falls", F.when(F.col("mean_prediction") < below, F.lit(1)).otherwise(F.lit(0)))
