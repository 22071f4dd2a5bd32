"""Column selectors by Spark type (the reference selects by pandas dtype)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_NARROW = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    """Integer and floating columns (the reference's int64/float64)."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, _NARROW) and f.name not in exclude]


def any_numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    """Every number type, decimals included."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def text_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def encodable_columns(df: DataFrame, exclude=()) -> list[str]:
    """Text and boolean columns (features that need encoding)."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, (T.StringType, T.BooleanType)) and f.name not in exclude]


def temporal_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))]


def is_floating(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType))


def missing(df: DataFrame, name: str):
    """Null-or-NaN predicate for one column."""
    from pyspark.sql import functions as F
    c = F.col(name)
    if is_floating(df, name):
        return c.isNull() | F.isnan(c)
    return c.isNull()
