"""Join operators: lookups, coverage indicators, rare-level collapse, alignment, price grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rare_level_collapse(df: DataFrame, c: str, min_count: int, out: str | None = None,
                        other: str = "other") -> DataFrame:
    """Levels with at least ``min_count`` rows keep their value; rare and NULL levels become ``other``.

    Level counts are partial-aggregated; the level table (one row per level) is
    joined back and Spark/AQE choose broadcast by its measured size."""
    out = out or c
    counts = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("_n"))
    keep = counts.where(F.col("_n") >= min_count).select(F.col(c).alias("_lvl"))
    j = df.join(keep, df[c] == keep["_lvl"], "left")
    val = F.when(F.col("_lvl").isNotNull(), F.col(c)).otherwise(F.lit(other))
    cols = [F.col(x) for x in df.columns if x != out]
    return j.select(*cols, val.alias(out))


def join_left_indicator(left: DataFrame, right_keys: DataFrame, on: Sequence[str], name: str) -> DataFrame:
    """Left join to a distinct key set with a 0/1 indicator (coverage)."""
    r = right_keys.select(*on).distinct().withColumn(name, F.lit(1))
    return left.join(r, list(on), "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)))


def outer_align(a: DataFrame, b: DataFrame, key: str, va: str, vb: str, diff: str = "diff") -> DataFrame:
    """Full outer join of two keyed aggregates, fill 0, difference a - b."""
    j = a.select(key, F.col(va).alias("_a")).join(b.select(key, F.col(vb).alias("_b")), key, "full_outer")
    return j.select(key, F.coalesce("_a", F.lit(0.0)).alias(va), F.coalesce("_b", F.lit(0.0)).alias(vb),
                    (F.coalesce("_a", F.lit(0.0)) - F.coalesce("_b", F.lit(0.0))).alias(diff))


def dim_lookup_default(df: DataFrame, dim: DataFrame, key: str, order: Sequence[str],
                       defaults: dict[str, object]) -> DataFrame:
    """Left join to the first dimension row per key (total order), with defaults."""
    from lodestar.operators.windows import first_per_key
    first = first_per_key(dim, [key], list(order) + [c for c in dim.columns if c != key and c not in order])
    j = df.join(first, key, "left")
    return j.select(*[F.coalesce(F.col(c), F.lit(defaults[c])).alias(c) if c in defaults else F.col(c)
                      for c in j.columns])


def grid_lookup(df: DataFrame, grid: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Equi-join on band columns to a fixed price grid (broadcast: the grid is a literal table)."""
    return df.join(F.broadcast(grid), list(keys), "left")
