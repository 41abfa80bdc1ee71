"""Exact interpolated quantiles without a single-task value map.

The built-in exact ``percentile`` merges every distinct value of a group in one task. Here a
first pass counts rows per monotone logarithmic bucket (map-side combined, so the shuffle
carries bucket counts only), and running counts name the few buckets that hold the wanted
ranks. A bucket that still holds too many rows is divided evenly between its smallest and largest
value, as often as needed; a last pass orders the values of the remaining buckets. No group is
collected and no value is approximated: the result is the linear interpolation between closest
ranks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardcast.functions.fixed import fixed_row, literal
from wardcast.session import via_table

#: Buckets per unit of ln(1+|v|); neighbouring buckets differ by 0.024 %.
RESOLUTION = float(2 ** 12)
#: Rows that one bucket may hold when its values are ordered.
ORDERABLE = 2_000_000
#: Parts of a bucket that is divided.
PARTS = 4096
#: Rows of a group whose values may be ordered as one array.
SMALL = 10_000


def _bucket(value: Column) -> Column:
    return F.coalesce(F.floor(F.signum(value) * F.log1p(F.abs(value)) * F.lit(RESOLUTION)), F.lit(0))


def _settled(hit: DataFrame, grouped: bool) -> tuple[DataFrame, int]:
    """The chosen buckets as data that is not computed again, and the rows of the fullest one."""
    if grouped:
        stored = via_table(hit, "buckets")
        return stored, stored.agg(F.max(F.when(F.col("lo") < F.col("hi"), F.col("c")))).first()[0] or 0
    # at most two buckets per metric and probability
    rows = hit.collect()
    known = hit.sparkSession.range(1).select(F.inline(literal(rows, T.ArrayType(hit.schema))))
    return F.broadcast(known), max((r["c"] for r in rows if r["lo"] < r["hi"]), default=0)


def _within(df: DataFrame, other: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join on keys in which null equals null."""
    other = other.withColumnsRenamed({k: f"__of_{k}" for k in keys})
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys])
    return df.join(other, same, how).drop(*[f"__of_{k}" for k in keys])


def _between(at, top: Column, p: Column) -> Column:
    """Interpolation between the closest ranks; ``at`` gives the value of a rank."""
    part = top * p - F.floor(top * p)
    low, high = at(F.floor(top * p)), at(F.ceil(top * p))
    # equal neighbours give exactly their value, so a strict comparison with it is safe
    return F.when(part < 0.5, low + (high - low) * part).otherwise(high - (high - low) * (1 - part))


def quantiles(
    df: DataFrame,
    columns: dict[str, Column],
    probs: Sequence[float],
    by: Sequence[str] = (),
    sets: Sequence[Sequence[str]] | None = None,
) -> DataFrame:
    """One row per group and metric: ``*by, metric, n, q`` with ``q`` in the order of ``probs``.

    Nulls and NaN are left out, so a conditional quantile is ``F.when(cond, value)``. With ``sets`` (lists of columns of ``by``) there are groups for each
    of them, numbered by a column ``set``, and columns not in a group's set are null. Counts per bucket are taken once, for all of ``by``, and added up
    for the sets; so all sets share the scans and the search.
    """
    by = list(by)
    group = ["set", *by, "metric"] if sets is not None else [*by, "metric"]
    # Where a bucket comes from: the buckets divided so far, outermost first.
    path, inner = "__path", [*group, "__path", "b"]
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), c.cast("double").alias("v")) for m, c in columns.items()])
    levels = F.array(*[F.lit(float(p)) for p in probs])
    top = F.col("n") - 1
    ranks = F.array_distinct(F.flatten(F.transform(levels, lambda p: F.array(F.floor(top * p), F.ceil(top * p)))))
    here = F.filter(ranks, lambda r: (r >= F.col("before")) & (r < F.col("upto")))
    counts = [F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi")]

    def chosen(buckets: DataFrame, upto: Column, n: Column) -> tuple[DataFrame, int]:
        ranged = buckets.select(*inner, "c", "lo", "hi", upto.alias("upto"), n.alias("n"))
        return _settled(
            ranged.withColumn("before", F.col("upto") - F.col("c")).where(F.size(here) > 0).drop("upto"), bool(by or sets)
        )

    values = (
        df.select(*by, F.inline(pairs))
        .where(F.col("v").isNotNull() & ~F.isnan("v"))
        .withColumns({path: F.lit(""), "b": _bucket(F.col("v"))})
    )
    whole = W.partitionBy(*group)
    if sets is None:
        first = values.groupBy(*inner).agg(*counts)
    else:
        kinds = {k: df.schema[k].dataType for k in by}
        each = F.explode(F.array(*[
            F.struct(F.lit(i).alias("set"), *[(F.col(k) if k in own else F.lit(None).cast(kinds[k])).alias(k) for k in by]) for i, own in enumerate(sets)])).alias("__in")

        def rolled(rows: DataFrame) -> DataFrame:
            return rows.select(each, *[c for c in rows.columns if c not in by]).select("__in.*", *[c for c in rows.columns if c not in by])

        fine = values.groupBy(*by, "metric", path, "b").agg(*counts)
        first = rolled(fine).groupBy(*inner).agg(F.sum("c").alias("c"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        values = rolled(values)
    hit, fullest = chosen(first, F.sum("c").over(whole.orderBy("b")), F.sum("c").over(whole))
    while fullest > ORDERABLE:  # ends: the smallest and the largest value of a bucket never stay together
        part = F.floor(F.coalesce(F.try_divide(F.col("v") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)) * F.lit(float(PARTS)))
        values = _within(values, hit.drop("c"), inner).select(
            *group, "v", "n", "before", F.concat_ws("/", path, F.col("b").cast("string")).alias(path), part.alias("b")
        )
        divided = values.groupBy(*inner, "n", "before").agg(*counts)
        running = F.sum("c").over(W.partitionBy(*group, path).orderBy("b"))
        values = values.select(*inner, "v")
        hit, fullest = chosen(divided, F.col("before") + running, F.col("n"))

    found = (
        _within(values, hit.select(*inner, "n", "before"), inner)
        .groupBy(*inner, "n", "before", "v")
        .agg(F.count("*").alias("c"))
        .withColumn("upto", F.col("before") + F.sum("c").over(W.partitionBy(*inner).orderBy("v")))
        .withColumn("before", F.col("upto") - F.col("c"))
        .select(*group, "n", "v", F.explode(here).alias("r"))
    )

    return (
        found.groupBy(*group, "n")
        # at most two ranks per probability
        .agg(F.map_from_entries(F.collect_set(F.struct("r", "v"))).alias("at"))
        .select(*group, "n", F.transform(levels, lambda p: _between(lambda r: F.element_at("at", r), top, p)).alias("q"))
    )


def _small_groups(df: DataFrame, columns: dict[str, Column], probs: Sequence[float], by: Sequence[str]) -> DataFrame:
    """``quantile_row`` of groups of at most ``SMALL`` rows: one shuffle, each group's values ordered as arrays."""
    row = F.struct(*[c.cast("double").alias(m) for m, c in columns.items()])
    held = df.groupBy(*by).agg(F.collect_list(row).alias("__rows"))
    held = held.select(*by, *[F.sort_array(F.filter(F.col("__rows")[m], lambda v: v.isNotNull() & ~F.isnan(v))).alias(m) for m in columns])
    levels = F.array(*[F.lit(float(p)) for p in probs])

    def cell(m: str) -> Column:
        n, values = F.size(m).cast("bigint"), F.col(m)
        q = F.transform(levels, lambda p: _between(lambda r: F.get(values, r.cast("int")), n - 1, p))
        return F.when(n > 0, F.struct(n.alias("n"), q.alias("q"))).alias(m)

    return held.where(F.greatest(*[F.size(m) for m in columns], F.lit(0)) > 0).select(*by, *[cell(m) for m in columns])


def quantile_row(
    df: DataFrame,
    columns: dict[str, Column],
    probs: Sequence[float],
    by: Sequence[str] = (),
) -> DataFrame:
    """One row per group: ``*by``, then a struct ``{metric: struct<n, q>}`` column per metric.

    When a count finds all groups small (requests, say), their values are ordered within the group, otherwise ``quantiles`` finds them; the results are the same.
    """
    if by and (df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0) <= SMALL:
        return _small_groups(df, columns, probs, by)
    long = quantiles(df, columns, probs, by)
    cells = [
        F.first(F.when(F.col("metric") == m, F.struct("n", "q")), ignorenulls=True).alias(m) for m in columns
    ]
    return long.groupBy(*by).agg(*cells)


def attach_by_batch(df: DataFrame, stats: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Put the statistics of a row's batch next to it as the struct column ``name``.

    Without batch columns the one statistics row is computed now and enters as a literal, so
    the big side is neither shuffled nor joined. Otherwise it is an equi join on the batch
    columns in which null is a batch like any other, and adaptive execution broadcasts or splits it by measured size.
    """
    by = list(by)
    if not by:
        return df.withColumn(name, fixed_row(stats))
    cells = [c for c in stats.columns if c not in by]
    return _within(df, stats.select(*by, F.struct(*cells).alias(name)), by, "left")
