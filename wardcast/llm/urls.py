"""URL filtering against dated lists: entries become validity intervals, captures are judged by the entries active when they were fetched.

Intervals are cut at the borders of ``PERIOD`` days, so that the as-of join is an equi join on (pattern, period) plus a
comparison of days: a host with many captures is split by the skew join, and one with many changes by its periods.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PERIOD = 32
SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*:)?//"


def host_of(url: Column) -> Column:
    """The lower-case host of a URL (a scheme may be missing, before ``//`` too): no user, port, path, query or fragment, no dot at the end; null without a host."""
    rest = F.regexp_replace(url, SCHEME, "")
    authority = F.regexp_replace(rest, r"[/?#\\].*$", "")
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r"(:[0-9]*)?$", ""))
    host = F.regexp_replace(host, r"\.$", "")
    return F.when(F.length(host) > 0, host)


def suffixes(host: Column) -> Column:
    """The host and its parent domains, longest first."""
    parts = F.split(host, r"\.")
    return F.when(host.isNotNull(), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")))


def validity(entries: DataFrame) -> DataFrame:
    """Intervals (list, pattern, first_day, end_day) from dated entries (list, pattern, day, action add or remove).

    An entry holds from its day on until the next one of the same list and pattern; end_day is exclusive and null while open.
    Of several entries of a day a removal wins; repeated entries count once. Entries with a null or another action are left out.
    Patterns compare in lower case. The entries of one list and pattern are those of its days at most.
    """
    rows = entries.where(F.col("list").isNotNull() & F.col("pattern").isNotNull() & F.col("day").isNotNull() & F.col("action").isin("add", "remove"))
    per_day = rows.groupBy("list", F.lower("pattern").alias("pattern"), "day").agg(F.max((F.col("action") == "remove").cast("int")).alias("gone"))
    line = Window.partitionBy("list", "pattern").orderBy("day")
    return per_day.withColumn("end_day", F.lead("day").over(line)).where("gone = 0").select("list", "pattern", F.col("day").alias("first_day"), "end_day")


def judged(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Each capture with the list entry that decides: capture columns plus ``decision``: struct(verdict, list, pattern, first_day).

    ``captures`` needs url and fetched (a date); ``entries`` list (``block`` or ``allow``), pattern, day and action. A pattern covers the host and all
    hosts below it. The longest pattern active on the day of the fetch decides; between lists of one length, allow does. Captures
    without an active pattern, a host or a day get verdict ``keep`` with nulls. Every capture gives one row, repeated
    ones too; without entries all are kept. Columns stay whatever their names; one named decision is replaced.
    """
    names = [c for c in captures.columns if c != "decision"]
    captures = captures.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("all"), "url", "fetched")
    period = F.lit(PERIOD)
    days = captures.agg(F.max("fetched")).first()[0]
    spans = validity(entries)
    last = F.least(F.coalesce(F.date_sub("end_day", 1), F.lit(days)), F.lit(days)) if days is not None else F.col("first_day")
    spans = spans.withColumn("_last", last).where("first_day <= _last").withColumn(
        "_period", F.explode(F.sequence(F.floor(F.unix_date("first_day") / period), F.floor(F.unix_date("_last") / period))))
    spans = spans.select(F.col("list").alias("_list"), F.col("pattern").alias("_pattern"), F.col("first_day").alias("_first"), F.col("end_day").alias("_end"), "_period")
    # The distinct (host, day) are judged, each once, and the captures look up theirs.
    keyed = captures.withColumn("_host", host_of(F.col("url")))
    asked = keyed.where("_host is not null and fetched is not null").select("_host", F.col("fetched").alias("_day")).distinct()
    tried = asked.select("_host", "_day", F.explode(suffixes(F.col("_host"))).alias("_pattern"), F.floor(F.unix_date("_day") / period).alias("_period"))
    active = tried.join(spans, ["_pattern", "_period"]).where("_first <= _day and (_end is null or _day < _end)")
    rank = F.struct(F.length("_pattern").alias("length"), (F.col("_list") == "allow").cast("int").alias("allow"), F.col("_list").alias("list"), F.col("_pattern").alias("pattern"), F.col("_first").alias("first_day"))
    best = active.groupBy("_host", "_day").agg(F.max(rank).alias("_best"))
    found = keyed.join(best.withColumnRenamed("_host", "_of"), (F.col("_host") == F.col("_of")) & (F.col("fetched") == F.col("_day")), "left")
    verdict = F.when(F.col("_best").isNull() | (F.col("_best.list") == "allow"), "keep").otherwise("drop")
    return found.select("all.*", F.struct(verdict.alias("verdict"), F.col("_best.list").alias("list"), F.col("_best.pattern").alias("pattern"), F.col("_best.first_day").alias("first_day")).alias("decision"))
