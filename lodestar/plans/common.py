"""Helpers shared by the query plans (Spark side and SQL side)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, FloatType, TimestampNTZType, TimestampType

DIGITS = 6


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every floating column and render dates/timestamps as ISO text so
    results compare across engines."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DateType, TimestampType, TimestampNTZType)):
            cols.append(F.col(f.name).cast("string").alias(f.name))
        elif isinstance(f.dataType, (DoubleType, FloatType)):
            cols.append(F.round(F.col(f.name).cast("double"), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def rnd(*names: str, digits: int = DIGITS) -> str:
    """SQL select list that rounds the named columns."""
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


def cte(**views: str) -> str:
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in views.items()) + "\n"
