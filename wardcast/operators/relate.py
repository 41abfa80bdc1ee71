"""Joins by key, sorts and unions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardcast.operators.quantiles import attach_by_batch

KEYS = ("hospital_id", "date")


def dim_lookup_join(df: DataFrame, dim: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join of a parameter table.

    No broadcast hint: Spark broadcasts the table when its measured size is below the session's
    threshold and otherwise shuffles, splitting skewed keys.
    """
    return df.join(dim, list(on), "left")


def predictions_to_actuals(predictions: DataFrame, actuals: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Forecast next to truth by key, never by row position."""
    return predictions.join(actuals, list(keys))


def sort_entity_time(df: DataFrame, keys: Sequence[str] = ("city", "hospital_id", "date")) -> DataFrame:
    """Total order by range partitioning; a big city or entity is split over ranges."""
    return df.orderBy(*keys)


def sort_time(df: DataFrame, time: str = "date", entity: str = "hospital_id") -> DataFrame:
    """Time order with reproducible ties."""
    return df.orderBy(time, entity)


def union_entities(*frames: DataFrame) -> DataFrame:
    """All rows by column name; columns a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def batch_scalar_join(df: DataFrame, stats: DataFrame, name: str = "batch", by: Sequence[str] = ()) -> DataFrame:
    """A statistic of the row's batch as a struct column next to each row."""
    return attach_by_batch(df, stats, name, by)


def average_forecast(df: DataFrame, column: str = "median", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n_rows"), F.avg(column).alias("mean_forecast"))


def first_record(df: DataFrame, request: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each request; one candidate per task and request is shuffled."""
    rest = [c for c in df.columns if c not in request]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("first")
    return df.groupBy(*request).agg(first).select(*request, "first.*")
