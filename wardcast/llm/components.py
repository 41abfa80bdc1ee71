"""Connected components of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardcast.session import via_table


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame, first: str = "a", second: str = "b") -> DataFrame:
    """(node, component) for every node with a link to another; component is the smallest node reachable.

    Links may repeat, point both ways or to themselves; those with a null end are left out. Each step is written to the
    shared folder. A node with a third of all links is split by the skew join, since joins alone
    bring its links together; minima are combined before the shuffle.
    """
    a, b = F.col(first), F.col(second)
    edges = via_table(links.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    before, now = None, _state(edges)
    while now != before:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = via_table(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        before, now = now, _state(edges)
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
