"""File sources and sinks: headered / positional CSV, JSON page envelopes,
multi-file lineage, idempotent sinks. All paths live under the shared
checkpoint folder when they are intermediate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def read_csv_strings(spark: SparkSession, path: str, columns: Sequence[str], keep: Sequence[str],
                     multiline: bool = False) -> DataFrame:
    """Headered CSV, every column read as text (no inference), then pruned. ``multiline``
    allows line breaks in quoted fields, and reads each file in a single task."""
    schema = StructType([StructField(c, StringType()) for c in columns])
    df = spark.read.csv(path, header=True, schema=schema, multiLine=multiline, escape='"')
    return df.select(*keep)


def read_csv_positional(spark: SparkSession, path: str, n_cols: int, keep: dict[int, str], sep: str = "|") -> DataFrame:
    """Headerless delimited file: keep ordinals and rename them."""
    schema = StructType([StructField(f"_c{i}", StringType()) for i in range(n_cols)])
    df = spark.read.csv(path, sep=sep, header=False, schema=schema)
    return df.select(*[F.col(f"_c{i}").alias(name) for i, name in keep.items()])


def read_json_envelope(spark: SparkSession, path: str, record_schema: str, multiline: bool = False) -> DataFrame:
    """Pages shaped {data: [{data: {...}}]} -> one row per record (one page per line,
    or one page per file with ``multiline=True``)."""
    env = spark.read.schema(f"data array<struct<data: struct<{record_schema}>>>").json(path, multiLine=multiline)
    return env.select(F.explode("data").alias("r")).select("r.data.*")


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> str:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def write_if_absent(df: DataFrame, path: str) -> str:
    """Skip the work when the output already exists (mode 'ignore')."""
    df.write.mode("ignore").parquet(path)
    return path
