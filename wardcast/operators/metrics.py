"""Forecast quality as plain aggregates, for a table or per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardcast.functions.fixed import fixed_row
from wardcast.functions.scalars import is_between
from wardcast.operators.quantiles import attach_by_batch, quantile_row


def _errors(y: Column, p: Column) -> dict[str, Column]:
    return {
        "n_rows": F.count("*"),
        "mae": F.avg(F.abs(y - p)),
        "rmse": F.sqrt(F.avg((y - p) * (y - p))),
        # 1 - SSE/SST; null for a constant target
        "r2": F.lit(1.0) - F.try_divide(F.avg((y - p) * (y - p)), F.var_pop(y)),
        "mean_y": F.avg(y),
    }


def regression_metrics(
    df: DataFrame, target: str = "y", prediction: str = "median", by: Sequence[str] = (), raw: bool = False
) -> DataFrame:
    """MAE, RMSE, R2 and accuracy in one pass.

    Rounded and floored at zero, or unrounded and unguarded with ``raw``.
    """
    y, p = F.col(target).cast("double"), F.col(prediction).cast("double")
    out = df.groupBy(*by).agg(*[c.alias(n) for n, c in _errors(y, p).items()])
    if raw:
        accuracy = (F.lit(1.0) - F.try_divide(F.col("mae"), F.col("mean_y"))) * 100
        return out.withColumn("accuracy", accuracy).drop("mean_y")
    share = F.when(F.col("mean_y") > 0, F.try_divide(F.col("mae"), F.col("mean_y"))).otherwise(F.col("mae"))
    accuracy = F.greatest(F.lit(0.0), (F.lit(1.0) - share) * 100)
    return out.select(
        *by, "n_rows", *[F.round(c, 4).alias(c) for c in ("mae", "rmse", "r2")], F.round(accuracy, 2).alias("accuracy")
    )


def quantile_coverage(df: DataFrame, target: str = "y", low: str = "lower", high: str = "upper", by: Sequence[str] = ()) -> DataFrame:
    """Share of targets inside the band, as a fraction and as a percentage."""
    inside = F.avg(is_between(F.col(target), F.col(low), F.col(high)))
    return df.groupBy(*by).agg(inside.alias("coverage")).withColumn("coverage_pct", F.round(F.col("coverage") * 100, 2))


def quantile_hit_rate(df: DataFrame, target: str = "y", columns: Sequence[str] = ("q10", "q50", "q90"), by: Sequence[str] = ()) -> DataFrame:
    below = [F.avg(F.when(F.col(target) <= F.col(c), F.lit(1.0)).otherwise(F.lit(0.0))).alias(f"hit_{c}") for c in columns]
    return df.groupBy(*by).agg(*below)


def pinball_loss(df: DataFrame, levels: dict[str, float], target: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """Mean pinball loss per predicted quantile column."""
    def loss(c: str, q: float) -> Column:
        d = F.col(target) - F.col(c)
        return F.avg(F.greatest(d * q, d * (q - 1)))

    return df.groupBy(*by).agg(*[loss(c, q).alias(f"pinball_{c}") for c, q in levels.items()])


def spike_metrics(df: DataFrame, target: str = "y", prediction: str = "median", level: float = 0.75) -> DataFrame:
    """Quality on rows above the level's percentile; no row when there are none."""
    y, p = F.col(target), F.col(prediction)
    stats = quantile_row(df, {"y": y}, [level])
    spikes = attach_by_batch(df, stats, "__s").where(y > F.col("__s.y.q")[0])
    out = spikes.agg(
        F.count("*").alias("n_spikes"),
        F.avg(F.abs(y - p)).alias("spike_mae"),
        F.sqrt(F.avg((y - p) * (y - p))).alias("spike_rmse"),
        (F.avg(F.when(p < y, F.lit(1.0)).otherwise(F.lit(0.0))) * 100).alias("underprediction_pct"),
        F.first("__s.y.q")[0].alias("threshold"),
    )
    return out.where(F.col("n_spikes") > 0)


def mean_std(df: DataFrame, column: str) -> DataFrame:
    """Mean and population deviation."""
    return df.agg(F.count(column).alias("n_scores"), F.avg(column).alias("mean_score"), F.stddev_pop(column).alias("std_score"))


def adjustment_stats(df: DataFrame, column: str, by: Sequence[str] = (), exact_tail: float = 0.95) -> DataFrame:
    """Average, range and upper percentile of a correction."""
    base = df.groupBy(*by).agg(F.count(column).alias("n_rows"), F.avg(column).alias("avg_value"), F.min(column).alias("min_value"), F.max(column).alias("max_value"))
    tail = quantile_row(df, {"v": F.col(column)}, [exact_tail], by)
    return attach_by_batch(base, tail, "__t", by).withColumn("p95_value", F.col("__t.v.q")[0]).drop("__t")


def profile_panel(
    df: DataFrame, entity: str = "hospital_id", city: str = "city", time: str = "date", approximate: bool = False
) -> DataFrame:
    """Rows, date range, city count and entity count.

    Distinct values are reduced before they are counted, so nothing unbounded is collected;
    ``approximate`` counts them with a fixed-size sketch and without a shuffle of the values.
    """
    if approximate:
        distinct = [F.approx_count_distinct(c).alias(n) for c, n in ((city, "n_cities"), (entity, "n_hospitals"))]
        return df.agg(F.count("*").alias("n_rows"), F.min(time).alias("first_date"), F.max(time).alias("last_date"), *distinct)
    return df.agg(
        F.count("*").alias("n_rows"), F.min(time).alias("first_date"), F.max(time).alias("last_date"),
        F.countDistinct(city).alias("n_cities"), F.countDistinct(entity).alias("n_hospitals"),
    )


def evaluate_forecast(df: DataFrame, target: str = "y", prediction: str = "median", low: str = "lower", high: str = "upper") -> DataFrame:
    """One row with unrounded metrics, band coverage and spike quality of a scored table."""
    overall = regression_metrics(df, target, prediction, raw=True)
    cover = quantile_coverage(df, target, low, high).select("coverage_pct")
    spikes = fixed_row(spike_metrics(df, target, prediction))
    return overall.select("*", fixed_row(cover)["coverage_pct"].alias("coverage_pct"), spikes.alias("s")).select(
        *overall.columns, "coverage_pct", "s.*"
    )


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """The distinct values of a column as rows, with their row counts."""
    return df.groupBy(column).agg(F.count("*").alias("n_rows"))
