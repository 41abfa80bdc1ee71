"""Building panels: rollup to days, dense calendars, event days, explained effects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardcast.functions.calendar import weekday_of, yearly_wave
from wardcast.functions.fixed import fixed_row
from wardcast.functions.scalars import flag


def daily_rollup(df: DataFrame, entity: Sequence[str], moment: str, measures: dict[str, Column]) -> DataFrame:
    """One row per entity and day; partial aggregation happens before the shuffle."""
    day = F.to_date(F.col(moment)).alias("date")
    return df.groupBy(*entity, day).agg(*[m.alias(n) for n, m in measures.items()])


def dense_calendar(df: DataFrame, entity: Sequence[str] = ("hospital_id",), time: str = "date", own_range: bool = False) -> DataFrame:
    """Every entity on every day of the table's range, or with ``own_range`` of its own, with the known rows attached.

    Each row brings the days up to its entity's next one, the first row also those before it. So the rows are shuffled once and nothing is joined.
    Rows of one entity and day all stay; rows without a day bring none. With the table's range the result has entities times days rows.
    """
    day, line = F.col(time), W.partitionBy(*entity).orderBy(time)
    following, before = F.lead(time).over(line), F.lag(time).over(line)
    first, last = day, F.coalesce(F.date_sub(following, 1), day)
    if not own_range:
        span = fixed_row(df.agg(F.min(time).alias("lo"), F.max(time).alias("hi")))
        first, last = F.when(before.isNull(), span["lo"]).otherwise(day), F.when(following.isNull(), span["hi"]).otherwise(F.date_sub(following, 1))
    cells = [c for c in df.columns if c not in (*entity, time)]
    known = F.struct(day.alias("day"), *cells).alias("__row")
    spans = df.where(day.isNotNull()).select(*entity, known, first.alias("__first"), F.greatest(last, day).alias("__last"))
    grid = spans.select(*entity, "__row", F.explode(F.sequence("__first", "__last")).alias(time))
    here = F.col(time) == F.col("__row.day")
    return grid.select(*entity, time, *[F.when(here, F.col(f"__row.{c}")).alias(c) for c in cells])


def near_event_days(events: DataFrame, day: str = "day", radius: int = 1) -> DataFrame:
    """Days within ``radius`` of an event with the number of events near: ``date, events_near``.

    Each event yields its own days, which turns the range join into an equi join.
    """
    around = F.sequence(F.date_sub(F.col(day), radius), F.date_add(F.col(day), radius))
    return events.select(F.explode(around).alias("date")).groupBy("date").agg(F.count("*").alias("events_near"))


def event_window_join(df: DataFrame, events: DataFrame, effect: float, day: str = "day", radius: int = 1) -> DataFrame:
    """Flag days near an event and add ``effect`` per event near."""
    near = near_event_days(events, day, radius)
    return df.join(near, "date", "left").withColumns({
        "near_flag": flag(F.col("events_near") > 0),
        "event_effect": F.coalesce(F.col("events_near"), F.lit(0)) * F.lit(float(effect)),
    }).drop("events_near")


def on_listed_days(df: DataFrame, days: DataFrame, keep: bool = True) -> DataFrame:
    """Rows whose date is in ``days`` (or is not)."""
    return df.join(days.select("date").distinct(), "date", "left_semi" if keep else "left_anti")


def calendar_flags(df: DataFrame, festivals: DataFrame, holidays: DataFrame, time: str = "date") -> DataFrame:
    """Weekday, weekend, festival (within a day) and holiday (exact day) columns."""
    near = near_event_days(festivals).select("date", F.lit(1).alias("__f"))
    exact = holidays.select(F.col("day").alias("date"), F.lit(1).alias("__h")).distinct()
    day = weekday_of(F.col(time))
    return (
        df.drop("weekday", "is_weekend", "festival_flag", "holiday_flag")
        .join(near, "date", "left").join(exact, "date", "left")
        .withColumns({
            "weekday": day, "is_weekend": flag(day >= 5),
            "festival_flag": F.coalesce("__f", F.lit(0)), "holiday_flag": F.coalesce("__h", F.lit(0)),
        }).drop("__f", "__h")
    )


def effect_decomposition(df: DataFrame, base: Column, city_number: Column, hospital_number: Column) -> DataFrame:
    """Deterministic contributions to a day's admissions, one column per term."""
    temp, aqi, rain = F.col("temp"), F.col("aqi"), F.col("rainfall")

    def above(value: Column, level: float) -> Column:
        return F.greatest(F.lit(0.0), value - F.lit(level))

    terms = {
        "weekday_term": F.when(F.col("weekday").isin(0, 1), F.lit(10.0))
        .when(F.col("weekday").isin(5, 6), F.lit(-12.0)).otherwise(F.lit(0.0)),
        "season_term": yearly_wave(F.col("date"), 8.0, 0.2),
        "cold_term": F.lit(0.6) * F.greatest(F.lit(0.0), F.lit(25.0) - temp),
        "heat_term": F.lit(0.4) * above(temp, 34.0),
        "drift_term": F.lit(0.02) * (city_number + 1) * hospital_number,
        "aqi_excess": above(aqi, 150.0),
        "heavy_rain": above(rain, 30.0),
        "mobility_term": F.lit(-0.025) * above(F.lit(100.0) - F.col("mobility_index"), 0.0),
        "outbreak_factor": F.lit(1.0) + F.col("outbreak_index") * F.lit(0.6),
        "holiday_factor": F.when(F.col("holiday_flag") == 1, F.lit(0.88)).otherwise(F.lit(1.0)),
    }
    additive = ["weekday_term", "season_term", "cold_term", "heat_term", "drift_term"]
    total = base
    for name in additive:
        total = total + F.col(name)
    return (
        df.withColumns(terms)
        .withColumn("baseline", total)
        .withColumn(
            "explained",
            (F.col("baseline") + F.col("mobility_term")) * F.col("outbreak_factor") * F.col("holiday_factor"),
        )
    )
