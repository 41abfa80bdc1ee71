"""Writing panels, plans and forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardcast.functions.scalars import fixed_point


def sink_csv_by_entity(df: DataFrame, base: str, layout: str = "xgb", city: str = "city", keep_city: bool = True) -> None:
    """One ``<city>_<layout>.csv`` folder per city in a single distributed write.

    Rebalancing by city keeps the number of files low and splits a city that is too big for
    one task. Cities written again are replaced, others stay.
    """
    named = df.withColumn("file", F.concat(F.lower(F.col(city)), F.lit(f"_{layout}.csv"))).hint("rebalance", "file")
    rows = named if keep_city else named.drop(city)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file").option("header", True).csv(base)


def sink_plan_json(df: DataFrame, path: str, as_of: Column, compression: str = "gzip") -> None:
    """Plans as JSON lines, one folder per run date; a date written again is replaced.

    Plans repeat most of their text, so files are compressed; rebalancing bounds what one of them holds, since such a file is read by one task.
    """
    dated = df.withColumn("run_date", F.to_date(as_of)).hint("rebalance")
    dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_date").json(path, compression=compression)


def prediction_records(df: DataFrame, digits: int = 6) -> DataFrame:
    """Each forecast row as one JSON record; a request is never gathered into one value."""
    numbers = [fixed_point(F.col(c), digits).alias(c) for c in ("lower", "median", "upper")]
    return df.withColumn("record", F.to_json(F.struct(F.col("date"), *numbers)))


def prediction_summary(df: DataFrame, by: str = "mode") -> DataFrame:
    """Record count per request or mode."""
    return df.groupBy(by).agg(F.count("*").alias("count"), F.lit("success").alias("status"))
