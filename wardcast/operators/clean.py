"""Audits, coercion, quarantine, duplicates and identifiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardcast.fixed_values import ALERT_LEVELS, MODES, TRAINING_COLUMNS, URGENCIES
from wardcast.functions.scalars import number_or_zero, present_items
from wardcast.operators.ordering import running_positions


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Fail before any job runs when a column is absent."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def column_audit(df: DataFrame, required: Sequence[str] = tuple(TRAINING_COLUMNS)) -> DataFrame:
    """One row per required column: presence, filled and null counts, smallest and largest number.

    A single pass over the table; absent columns are reported, not raised.
    """
    present = [c for c in required if c in df.columns]
    cells = []
    for c in present:
        kind = df.schema[c].dataType
        number = F.col(c).try_cast("double") if isinstance(kind, (T.NumericType, T.StringType)) else F.lit(None).cast("double")
        cells += [F.count(c).alias(f"{c}|filled"), F.min(number).alias(f"{c}|low"), F.max(number).alias(f"{c}|high")]
    row = df.agg(F.count("*").alias("n"), *cells)
    entries = []
    for c in required:
        known = c in present
        filled = F.col(f"{c}|filled") if known else F.lit(0).cast("bigint")
        entries.append(F.struct(
            F.lit(c).alias("column_name"),
            F.lit(int(known)).alias("present"),
            filled.alias("filled"),
            (F.col("n") - filled).alias("nulls"),
            (F.col(f"{c}|low") if known else F.lit(None).cast("double")).alias("low"),
            (F.col(f"{c}|high") if known else F.lit(None).cast("double")).alias("high"),
        ))
    return row.select(F.inline(F.array(*entries)))


def coerce_date(df: DataFrame, column: str = "date", fmt: str = "yyyy-MM-dd") -> DataFrame:
    """Text to date; unreadable text becomes null."""
    return df.withColumn(column, F.try_to_date(F.col(column).cast("string"), fmt))


def coerce_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: number_or_zero(F.col(c).cast("string")) for c in columns})


def with_reasons(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Add ``reject_reasons``: names of the rules a row breaks (a null counts as broken)."""
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return df.withColumn("reject_reasons", present_items(*broken))


def valid_rows(df: DataFrame) -> DataFrame:
    return df.where(F.size("reject_reasons") == 0).drop("reject_reasons")


def rejected_rows(df: DataFrame) -> DataFrame:
    return df.where(F.size("reject_reasons") > 0)


def mode_rule(column: str = "mode") -> dict[str, Column]:
    return {"mode": F.col(column).isin(MODES)}


def score_range_rules(aqi: str = "aqi", scores: Sequence[str] = ()) -> dict[str, Column]:
    rules = {f"{aqi}_negative": F.col(aqi) >= 0}
    return rules | {f"{s}_outside_0_1": F.col(s).between(0.0, 1.0) for s in scores}


def vocabulary_rules(alert: str = "alert_level", urgency: str = "urgency") -> dict[str, Column]:
    return {"alert_level": F.col(alert).isin(ALERT_LEVELS), "urgency": F.col(urgency).isin(URGENCIES)}


def count_duplicates(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys held by more than one row, the rows they hold, and the rows beyond the first."""
    counts = df.groupBy(*key).agg(F.count("*").alias("c")).where(F.col("c") > 1)
    return counts.agg(
        F.count("*").alias("duplicate_keys"),
        F.coalesce(F.sum("c"), F.lit(0)).alias("duplicate_rows"),
        F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("surplus_rows"),
    )


def dedup_keep_first(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the first by ``order``.

    ``min_by`` keeps one candidate per key and task before the shuffle, so a key holding a
    large share of all rows costs one row per task.
    """
    rest = [c for c in df.columns if c not in key]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("first")
    return df.groupBy(*key).agg(first).select(*[c if c in key else F.col("first")[c].alias(c) for c in df.columns])


def add_missing_as_zero(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    absent = [c for c in columns if c not in df.columns]
    return df.withColumns({c: F.lit(0.0) for c in absent}) if absent else df


def derive_entity_id(df: DataFrame, city: str = "city", time: str = "date", name: str = "hospital_id") -> DataFrame:
    """Entity id from ``group_id``, else city and code, else city and a running number."""
    if name in df.columns:
        return df
    if "group_id" in df.columns:
        return df.withColumn(name, F.col("group_id"))
    if "hospital_id_enc" in df.columns:
        return df.withColumn(name, F.concat_ws("_", F.col(city), F.col("hospital_id_enc").cast("string")))
    raise ValueError("no group_id or hospital_id_enc: number the rows with number_within and a unique column")


def number_within(df: DataFrame, city: str, tie: str, time: str = "date", name: str = "hospital_id") -> DataFrame:
    """City name and running number within the city; ``tie`` makes equal days reproducible."""
    numbered = running_positions(df, [city], tie, time, "__n")
    return numbered.withColumn(name, F.concat_ws("_", F.col(city), F.col("__n").cast("string"))).drop("__n")
