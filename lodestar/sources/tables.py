"""Typed readers over the parquet tables.

Readers return lazy DataFrames; selecting columns right after the read lets
Catalyst prune the parquet scan (``ReadSchema``) and push filters down.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.session import prepare

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    prepare(spark)
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


def scan_parquet(spark: SparkSession, path: str, columns=None, where=None) -> DataFrame:
    """Parquet scan with column pruning and an optional pushed-down predicate."""
    df = spark.read.parquet(path)
    if where is not None:
        df = df.where(where)
    return df.select(*columns) if columns else df
