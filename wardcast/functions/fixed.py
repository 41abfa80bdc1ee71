"""Small results as literals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def literal(value: object, kind: T.DataType) -> Column:
    """A driver value as a typed literal, structs and arrays included."""
    if value is None:
        return F.lit(None).cast(kind)
    if isinstance(kind, T.StructType):
        return F.struct(*[literal(v, f.dataType).alias(f.name) for v, f in zip(value, kind.fields)])
    if isinstance(kind, T.ArrayType):
        return F.array(*[literal(v, kind.elementType) for v in value]).cast(kind)
    return F.lit(value).cast(kind)


def fixed_row(df: DataFrame) -> Column:
    """Run a query that yields one row of fixed size and return that row as a literal struct.

    What depends on it stays one flat scan: the statistics are not planned again inside every
    later query, nor run again by every pass of an iterative fit.
    """
    return literal(df.first(), df.schema)
