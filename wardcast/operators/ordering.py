"""Global and per-group positions, time splits and top rows without a single-task sort.

Rows are ordered by (time, md5 of the entity, entity). The md5 makes ties on one day fall in a
reproducible order and spreads any day, however hot, over ``BUCKETS`` equal parts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Hex digits of the md5 that form the bucket: 4096 parts per day.
DIGITS = 3


def require_days(df: DataFrame, time: str) -> None:
    """Refuse a time that is no date: the steps below order one row per day in one task, which timestamps would not bound."""
    kind = df.schema[time].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        raise ValueError(f"{time} is a {kind.simpleString()}; cast it to a date")


def tie_key(entity: str) -> Column:
    return F.md5(F.col(entity).cast("string"))


def running_positions(
    df: DataFrame, group: Sequence[str] = (), entity: str = "hospital_id", time: str = "date", name: str = "position"
) -> DataFrame:
    """0-based position of each row in its group (or the whole table) by (time, tie key).

    Counts per (group, day, bucket) give the offset of each bucket; only the small count table
    is ordered as a whole. The rows themselves are ordered within one bucket of one day.
    """
    require_days(df, time)
    group = list(group)
    keyed = df.withColumns({"__tie": tie_key(entity), "__part": F.left(tie_key(entity), F.lit(DIGITS))})
    slot = [*group, time, "__part"]
    days = keyed.groupBy(*slot).agg(F.count("*").alias("__c"))
    per_day = W.partitionBy(*group, time)
    # one row per group and day: a century is 36,500 rows
    over_days = W.partitionBy(*(group or [F.lit(0)])).orderBy(time)
    day_offsets = days.groupBy(*group, time).agg(F.sum("__c").alias("__d"))
    day_offsets = day_offsets.withColumn("__day", F.sum("__d").over(over_days) - F.col("__d")).drop("__d")
    offsets = days.select(
        *slot, (F.sum("__c").over(per_day.orderBy("__part")) - F.col("__c")).alias("__in_day")
    ).join(day_offsets, [*group, time])
    offsets = offsets.select(*slot, (F.col("__day") + F.col("__in_day")).alias("__before"))
    rank = F.row_number().over(W.partitionBy(*slot).orderBy("__tie", entity))
    return (
        keyed.withColumn("__rank", rank)
        .join(offsets, slot)
        .withColumn(name, F.col("__before") + F.col("__rank") - 1)
        .select(*df.columns, name)
    )


def cut_keys(df: DataFrame, cuts: DataFrame, entity: str = "hospital_id", time: str = "date") -> DataFrame:
    """The (time, tie, entity) key at each wanted position: ``cut_id, day, tie, who``.

    ``cuts`` holds a handful of rows ``cut_id, at`` (1-based positions). The search narrows from
    days to one bucket of one day, so no step orders more than that bucket, and the table
    itself is only scanned for two columns.
    """
    require_days(df, time)
    keys = df.select(F.col(time).alias("day"), F.col(entity).alias("who"), tie_key(entity).alias("tie"))
    keys = keys.withColumn("part", F.left("tie", F.lit(DIGITS)))
    wanted = cuts.select(F.sort_array(F.collect_list(F.struct("at", "cut_id"))).alias("w"))
    days = keys.groupBy("day").agg(F.count("*").alias("c"))
    days = days.withColumn("upto", F.sum("c").over(W.partitionBy(F.lit(0)).orderBy("day")))
    in_day = (
        days.withColumn("w", wanted.scalar())
        .select("day", F.col("upto"), F.col("c"), F.explode("w").alias("w"))
        .where((F.col("w.at") <= F.col("upto")) & (F.col("w.at") > F.col("upto") - F.col("c")))
        .select("w.cut_id", "day", (F.col("w.at") - F.col("upto") + F.col("c")).alias("at"))
    )
    # one row per cut
    parts = keys.join(F.broadcast(in_day), "day").groupBy("cut_id", "day", "at", "part").agg(F.count("*").alias("c"))
    parts = parts.withColumn("upto", F.sum("c").over(W.partitionBy("cut_id").orderBy("part")))
    in_part = parts.where((F.col("at") <= F.col("upto")) & (F.col("at") > F.col("upto") - F.col("c"))).select(
        "cut_id", "day", "part", (F.col("at") - F.col("upto") + F.col("c")).alias("at")
    )
    rank = F.row_number().over(W.partitionBy("cut_id").orderBy("tie", "who"))
    return (
        keys.join(F.broadcast(in_part), ["day", "part"])
        .withColumn("rank", rank)
        .where(F.col("rank") == F.col("at"))
        .select("cut_id", "day", "tie", "who")
    )


def group_cuts(df: DataFrame, by: str, at: Sequence[Column], entity: str = "hospital_id", time: str = "date") -> DataFrame:
    """``by, cuts``: the (day, tie, who) keys of the rows of each group at the positions ``at`` (1-based, expressions over its row count ``n``), in order.

    As in ``cut_keys`` the search narrows from days to one bucket of one day; only keys are read, and no step orders more than a group's days or one bucket.
    Positions below 1 have no key.
    """
    require_days(df, time)
    keys = df.select(F.col(by).alias("g"), F.col(time).alias("day"), F.col(entity).alias("who"), tie_key(entity).alias("tie"))
    keys = keys.withColumn("part", F.left("tie", F.lit(DIGITS)))
    days = keys.groupBy("g", "day").agg(F.count("*").alias("c"))
    whole = W.partitionBy("g")
    days = days.withColumns({"upto": F.sum("c").over(whole.orderBy("day")), "n": F.sum("c").over(whole)})
    wanted = F.array(*(F.struct(F.lit(i).alias("cut"), c.cast("bigint").alias("at")) for i, c in enumerate(at)))
    in_day = days.select("g", "day", "upto", "c", F.explode(wanted).alias("w")).where((F.col("w.at") <= F.col("upto")) & (F.col("w.at") > F.col("upto") - F.col("c")))
    in_day = in_day.select(F.col("g").alias("g2"), F.col("day").alias("day2"), "w.cut", (F.col("w.at") - F.col("upto") + F.col("c")).alias("at"))
    same = F.col("g").eqNullSafe(F.col("g2")) & F.col("day").eqNullSafe(F.col("day2"))
    parts = keys.join(in_day, same).groupBy("g", "day", "cut", "at", "part").agg(F.count("*").alias("c"))
    parts = parts.withColumn("upto", F.sum("c").over(W.partitionBy("g", "cut").orderBy("part")))
    in_part = parts.where((F.col("at") <= F.col("upto")) & (F.col("at") > F.col("upto") - F.col("c"))).select(
        F.col("g").alias("g2"), F.col("day").alias("day2"), F.col("part").alias("part2"), "cut", (F.col("at") - F.col("upto") + F.col("c")).alias("at"))
    rank = F.row_number().over(W.partitionBy("g", "cut").orderBy("tie", "who"))
    found = keys.join(in_part, same & (F.col("part") == F.col("part2"))).withColumn("rank", rank).where(F.col("rank") == F.col("at"))
    return found.groupBy(F.col("g").alias(by)).agg(F.sort_array(F.collect_list(F.struct("day", "tie", "who"))).alias("cuts"))


def _count_cuts(df: DataFrame, cuts: list[Column]) -> DataFrame:
    """``cut_id, at`` rows from expressions over the row count ``n``."""
    rows = [F.struct(F.lit(i).alias("cut_id"), c.cast("bigint").alias("at")) for i, c in enumerate(cuts)]
    return df.agg(F.count("*").alias("n")).select(F.inline(F.array(*rows)))


def _cuts(df: DataFrame, cuts: list[Column], entity: str, time: str) -> list[Column]:
    """For each cut a condition that is true up to and including the row at that position.

    One key per cut comes to the driver. The leading comparison of the time column stands
    alone, so a filter with the condition is pushed into the scan.
    """
    found = {r["cut_id"]: r for r in cut_keys(df, _count_cuts(df, cuts), entity, time).collect()}
    conditions = []
    for i in range(len(cuts)):
        if i not in found:
            conditions.append(F.lit(False))
            continue
        day, tie = F.col(time), tie_key(entity)
        last = F.lit(found[i]["day"]).cast(df.schema[time].dataType)
        who = F.lit(found[i]["who"]).cast(df.schema[entity].dataType)
        at = F.lit(found[i]["tie"])
        conditions.append((day <= last) & ((day < last) | (tie < at) | ((tie == at) & (F.col(entity) <= who))))
    return conditions


def time_split(
    df: DataFrame, train_ratio: float = 0.85, entity: str = "hospital_id", time: str = "date", name: str = "split"
) -> DataFrame:
    """Mark the first ``int(n * ratio)`` rows in time order ``train`` and the rest ``validation``.

    The key at the cut is found first and enters as a literal, so marking moves no rows.
    """
    early = _cuts(df, [F.col("n") * F.lit(float(train_ratio))], entity, time)[0]
    return df.withColumn(name, F.when(early, F.lit("train")).otherwise(F.lit("validation")))


def expanding_folds(df: DataFrame, folds: int = 3, entity: str = "hospital_id", time: str = "date") -> DataFrame:
    """Rows of each time-ordered fold: ``fold`` (1-based) and ``part`` (train or validation).

    Each fold validates on ``n // (folds + 1)`` rows and trains on everything before them.
    """
    size = F.floor(F.col("n") / F.lit(folds + 1))
    upto = _cuts(df, [F.col("n") - F.lit(folds - i) * size for i in range(folds + 1)], entity, time)
    steps = []
    for i in range(folds):
        part = F.when(upto[i], F.lit("train")).when(upto[i + 1], F.lit("validation"))
        steps.append(F.struct(F.lit(i + 1).alias("fold"), part.alias("part")))
    return df.select("*", F.inline(F.array(*steps))).where(F.col("part").isNotNull())


def top_rows(df: DataFrame, order: Sequence[Column], k: int, by: Sequence[str] = ()) -> DataFrame:
    """First ``k`` rows of the table or of each group; the limit is applied before any shuffle."""
    if not by:
        return df.orderBy(*order).limit(k)
    rank = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= k).drop("__rank")
